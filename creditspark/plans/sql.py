"""SQL text of the stage plans, for the DuckDB oracle.

Each function returns CTE definitions (without ``WITH``) that mirror the
DataFrame plan of the same name in ``plans.prepare`` / ``plans.queries``.
The categories of the encoders are the domains of the driver tables'
source columns (the Spark side fits them from data and must find these).
"""

from __future__ import annotations

from ..functions.expr import right_closed_bins_sql
from ..functions.hashing import mix_sql
from ..operators import features as Fe
from ..sources.loan_book import LOAN_BOOK_SQL

LOAN_COLUMNS = ["loan_id", "person_age", "person_income", "person_home_ownership", "person_emp_length",
                "loan_intent", "loan_grade", "loan_amnt", "loan_int_rate", "cb_person_default_on_file",
                "cb_person_cred_hist_length", "loan_percent_income", "loan_status"]
NUMERIC_RAW = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate",
               "cb_person_cred_hist_length", "loan_percent_income", "loan_status"]
CATEGORICAL_RAW = ["person_home_ownership", "loan_intent", "loan_grade", "cb_person_default_on_file"]
DTYPES = {"loan_id": "bigint", "person_age": "int", "person_income": "bigint",
          "person_home_ownership": "string", "person_emp_length": "double", "loan_intent": "string",
          "loan_grade": "string", "loan_amnt": "bigint", "loan_int_rate": "double",
          "cb_person_default_on_file": "string", "cb_person_cred_hist_length": "int",
          "loan_percent_income": "double", "loan_status": "int"}

# Domains of the source columns in the driver tables (fitted categories must equal these).
CATEGORIES = {
    "person_home_ownership": ["MORTGAGE", "OTHER", "OWN", "RENT"],
    "loan_intent": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "income_group": sorted(Fe.INCOME_LABELS),
    "loan_amount_group": sorted(Fe.AMOUNT_LABELS),
}
LABEL_CLASSES = {
    "loan_grade": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "cb_person_default_on_file": ["N", "Y"],
}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def loan_book_cte() -> str:
    return LOAN_BOOK_SQL.strip()


def imputed_cte() -> str:
    """dedup (keep smallest key) -> mean rate -> median employment length."""
    raw = [c for c in LOAN_COLUMNS if c != "loan_id"]
    return f"""{loan_book_cte()},
dd AS (SELECT MIN(loan_id) AS loan_id, {', '.join(raw)} FROM loan_book GROUP BY {', '.join(raw)}),
imputed AS (
  SELECT loan_id, person_age, person_income, person_home_ownership,
    COALESCE(person_emp_length, (SELECT quantile_cont(person_emp_length, 0.5) FROM dd)) AS person_emp_length,
    loan_intent, loan_grade, loan_amnt,
    COALESCE(loan_int_rate, (SELECT AVG(loan_int_rate) FROM dd)) AS loan_int_rate,
    cb_person_default_on_file, cb_person_cred_hist_length, loan_percent_income, loan_status
  FROM dd)"""


def iqr_bounds_sql(table: str, col: str, name: str) -> str:
    return f"""{name} AS (
  SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {table}))"""


def cleaned_cte() -> str:
    """``data_outlier``: IQR filter on the history length, then age < 100."""
    return f"""{imputed_cte()},
{iqr_bounds_sql('imputed', 'cb_person_cred_hist_length', 'iqr_b')},
iqr_kept AS (SELECT imputed.* FROM imputed, iqr_b
  WHERE cb_person_cred_hist_length BETWEEN iqr_b.lo AND iqr_b.hi),
cleaned AS (SELECT * FROM iqr_kept WHERE person_age < 100)"""


def safe_div_sql(a: str, b: str) -> str:
    return f"CASE WHEN CAST({b} AS DOUBLE) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def ratios_sql() -> list[str]:
    return [f"{safe_div_sql('loan_amnt', 'person_income')} AS loan_to_income_ratio",
            f"{safe_div_sql('person_emp_length', 'loan_amnt')} AS loan_to_emp_length_ratio",
            f"{safe_div_sql('loan_int_rate', 'loan_amnt')} AS int_rate_to_loan_amt_ratio"]


def bins_sql() -> list[str]:
    return [f"{right_closed_bins_sql('person_income', Fe.INCOME_EDGES, Fe.INCOME_LABELS)} AS income_group",
            f"{right_closed_bins_sql('loan_amnt', Fe.AMOUNT_EDGES, Fe.AMOUNT_LABELS)} AS loan_amount_group"]


def feature_names() -> list[str]:
    """Engineered feature columns in the Spark plan's order."""
    base = ["person_age", "person_emp_length", "loan_grade", "loan_int_rate",
            "cb_person_default_on_file", "cb_person_cred_hist_length", "loan_percent_income"]
    base += Fe.RATIO_COLUMNS
    for c in Fe.ONE_HOT_COLUMNS:
        base += [f"{c}_{v}" for v in CATEGORIES[c]]
    return base


def engineered_cte() -> str:
    """ratios -> bins -> one-hot -> label codes, over ``cleaned``."""
    return f"{cleaned_cte()},\n{engineer_cte('cleaned')}"


def applications_cte() -> str:
    """Every loan-book row with the imputation values of the deduplicated rows, then engineered."""
    return f"""{imputed_cte()},
applications AS (
  SELECT loan_id, person_age, person_income, person_home_ownership,
    COALESCE(person_emp_length, (SELECT quantile_cont(person_emp_length, 0.5) FROM dd)) AS person_emp_length,
    loan_intent, loan_grade, loan_amnt, COALESCE(loan_int_rate, (SELECT AVG(loan_int_rate) FROM dd)) AS loan_int_rate,
    cb_person_default_on_file, cb_person_cred_hist_length, loan_percent_income, loan_status
  FROM loan_book),
{engineer_cte('applications')}"""


def engineer_cte(source: str) -> str:
    onehot = [f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {q(f'{c}_{v}')}"
              for c in Fe.ONE_HOT_COLUMNS for v in CATEGORIES[c]]
    codes = []
    for c, vals in LABEL_CLASSES.items():
        whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(vals))
        codes.append(f"CAST(CASE {c} {whens} END AS INTEGER) AS {c}")
    return f"""fe1 AS (SELECT *, {', '.join(ratios_sql())}, {', '.join(bins_sql())} FROM {source}),
engineered AS (
  SELECT loan_id, person_age, person_emp_length, {codes[0]}, loan_int_rate, loan_status,
    loan_percent_income, {codes[1]}, cb_person_cred_hist_length,
    loan_to_income_ratio, loan_to_emp_length_ratio, int_rate_to_loan_amt_ratio,
    {', '.join(onehot)}
  FROM fe1)"""


def scaled_cte(source: str = "engineered", fit_on: str | None = None, name: str = "scaled") -> str:
    """(x - mean) / population std (0 -> 1), NULL -> 0.0, fitted on ``fit_on``."""
    feats = feature_names()
    fit_on = fit_on or source
    stats = ", ".join(f"AVG(CAST({q(f)} AS DOUBLE)) AS m{i}, STDDEV_POP(CAST({q(f)} AS DOUBLE)) AS s{i}"
                      for i, f in enumerate(feats))
    cols = ", ".join(
        f"COALESCE((CAST({q(f)} AS DOUBLE) - {name}_st.m{i}) / "
        f"(CASE WHEN {name}_st.s{i} IS NULL OR {name}_st.s{i} = 0 THEN 1.0 ELSE {name}_st.s{i} END), 0.0) AS {q(f)}"
        for i, f in enumerate(feats))
    return f"""{name}_st AS (SELECT {stats} FROM {fit_on}),
{name} AS (SELECT {source}.loan_id, {source}.loan_status, {cols} FROM {source}, {name}_st)"""


def split_pred(table: str = "cleaned", key: str = "loan_id", seed: int = 42, test_fraction: float = 0.2) -> str:
    """Test rows of ``table``: those of the smallest (hash, key), a fifth rounded up."""
    n = f"(COUNT(*) OVER () * {int(round(1000 * test_fraction))} + 999) // 1000"
    return f"{key} IN (SELECT {key} FROM {table} QUALIFY ROW_NUMBER() OVER (ORDER BY {mix_sql(key, seed)}, {key}) <= {n})"


def eval_cte() -> str:
    """Deterministic classifier output over the loan book: label, score, prediction."""
    noise = f"(CAST({mix_sql('loan_id', 7)} % 1000 AS DOUBLE) / 1000.0)"
    r = "(CAST(loan_amnt AS DOUBLE) / (CAST(loan_amnt AS DOUBLE) + 0.5 * ABS(CAST(person_income AS DOUBLE)) + 1.0))"
    return f"""{loan_book_cte()},
scored AS (
  SELECT loan_id, loan_status AS label, loan_grade,
    FLOOR(1000.0 * (0.8 * {r} + 0.2 * {noise})) / 1000.0 AS score
  FROM loan_book),
evals AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)"""


def cluster_points_cte() -> str:
    """Scaled clustering features of ``cleaned`` plus the ownership group."""
    feats = Fe.CLUSTER_FEATURES
    stats = ", ".join(f"AVG(CAST({f} AS DOUBLE)) AS m{i}, STDDEV_POP(CAST({f} AS DOUBLE)) AS s{i}"
                      for i, f in enumerate(feats))
    cols = ", ".join(f"COALESCE((CAST({f} AS DOUBLE) - cp_st.m{i}) / "
                     f"(CASE WHEN cp_st.s{i} IS NULL OR cp_st.s{i} = 0 THEN 1.0 ELSE cp_st.s{i} END), 0.0) AS {f}"
                     for i, f in enumerate(feats))
    own = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(CATEGORIES["person_home_ownership"]))
    return f"""{cleaned_cte()},
cp_st AS (SELECT {stats} FROM cleaned),
cpoints AS (SELECT loan_id, CASE person_home_ownership {own} END AS grp, {cols} FROM cleaned, cp_st),
cents AS (SELECT grp AS cid, {', '.join(f'AVG({f}) AS c_{f}' for f in feats)} FROM cpoints GROUP BY grp),
dists AS (
  SELECT p.loan_id, c.cid,
    {' + '.join(f'(p.{f} - c.c_{f}) * (p.{f} - c.c_{f})' for f in feats)} AS d
  FROM cpoints p, cents c),
assigned AS (
  SELECT p.*, a.cid AS cluster FROM cpoints p JOIN (
    SELECT loan_id, cid FROM (
      SELECT loan_id, cid, ROW_NUMBER() OVER (PARTITION BY loan_id ORDER BY d, cid) AS rn FROM dists)
    WHERE rn = 1) a ON a.loan_id = p.loan_id)"""


def pca_cte(rounds: int = 40) -> str:
    """First two principal components of the scaled clustering features: the 4 x 4 covariance matrix is squared (and
    scaled) ``rounds`` times, which leaves the outer product of its leading eigenvector, then deflated and squared again.
    Each component's largest loading is positive."""
    feats = Fe.CLUSTER_FEATURES
    n = range(len(feats))
    cov = ", ".join(f"AVG({feats[i]} * {feats[j]}) - AVG({feats[i]}) * AVG({feats[j]}) AS c{i}{j}" for i in n for j in n)

    def power(name: str, matrix: str) -> str:
        trace = " + ".join(f"s{i}{i}" for i in n)
        square = ", ".join(" + ".join(f"c{i}{k} * c{k}{j}" for k in n) + f" AS s{i}{j}" for i in n for j in n)
        top = "GREATEST(" + ", ".join(f"c{i}{i}" for i in n) + ")"
        # column of the largest diagonal entry over its root: that loading is positive and the largest
        vec = ", ".join(f"CASE {top} " + " ".join(f"WHEN c{j}{j} THEN c{i}{j} / SQRT(c{j}{j})" for j in n) + f" END AS v{i}" for i in n)
        return f"""{name}_it AS (
  SELECT 0 AS it, {', '.join(f'c{i}{j}' for i in n for j in n)} FROM {matrix}
  UNION ALL
  SELECT it + 1, {', '.join(f's{i}{j} / ({trace})' for i in n for j in n)} FROM (
    SELECT it, {square} FROM {name}_it WHERE it < {rounds}) t),
{name} AS (SELECT {vec} FROM {name}_it WHERE it = {rounds})"""

    value = " + ".join(f"a.v{i} * m.c{i}{j} * a.v{j}" for i in n for j in n)
    rest = ", ".join(f"m.c{i}{j} - l.val * a.v{i} * a.v{j} AS c{i}{j}" for i in n for j in n)
    return f"""{cluster_points_cte()},
cov AS (SELECT {cov} FROM cpoints),
{power('pc1', 'cov')},
lead AS (SELECT {value} AS val FROM pc1 a, cov m),
cov2 AS (SELECT {rest} FROM cov m, pc1 a, lead l),
{power('pc2', 'cov2')},
pca AS (SELECT p.loan_id, {' + '.join(f'p.{f} * a.v{i}' for i, f in enumerate(feats))} AS PCA1,
  {' + '.join(f'p.{f} * b.v{i}' for i, f in enumerate(feats))} AS PCA2 FROM cpoints p, pc1 a, pc2 b)"""
