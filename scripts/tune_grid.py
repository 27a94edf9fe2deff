"""Work off the full classifier grid (288 settings x 5 folds) in as many runs as it takes.

usage: python scripts/tune_grid.py SF_DIR FOLDER [FITS]

FOLDER keeps the balanced training table and the ledger of fits; each run adds at most FITS fits (default: all that are
missing) and prints how far the grid is. A run that is killed loses the fits it was at.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from creditspark.operators import models as M  # noqa: E402
from creditspark.plans import jobs as J  # noqa: E402
from creditspark.session import get_spark  # noqa: E402
from creditspark.sources import KEY, LABEL, loan_book  # noqa: E402
from creditspark.sources.files import save_model  # noqa: E402
from creditspark.sources.versions import path_exists  # noqa: E402


def main() -> None:
    sf, folder = sys.argv[1], sys.argv[2].rstrip("/")
    fits = int(sys.argv[3]) if len(sys.argv) > 3 else None
    spark = get_spark()
    train = f"{folder}/train"
    if not path_exists(spark, f"{train}/_SUCCESS"):
        J.prepare_classifier(loan_book(spark, sf), f"{folder}/stages").balanced.write.mode("overwrite").parquet(train)
    data = spark.read.parquet(train)
    features = [c for c in data.columns if c not in (KEY, LABEL, "copy_no")]
    model, table = M.grid_search(data, features, LABEL, ledger=f"{folder}/ledger", max_fits=fits)
    print(f"{table.where(F.col('cv_accuracy').isNotNull()).count()} of {table.count()} settings are done")
    if model is not None:
        save_model(model, f"{folder}/model")
        table.orderBy(F.col("cv_accuracy").desc(), "setting").show(10, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
