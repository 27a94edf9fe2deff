from .files import (KEYED_SCHEMA, RAW_SCHEMA, load_model, nan_to_null, read_loan_csv, read_stage,
                    save_model, stage_path, write_loan_csv, write_stage)
from .loan_book import KEY, LABEL, LOAN_BOOK_SQL, RAW_COLUMNS, loan_book
from .tables import TABLES, read_table, table_path

__all__ = [
    "KEYED_SCHEMA", "RAW_SCHEMA", "load_model", "nan_to_null", "read_loan_csv", "read_stage",
    "save_model", "stage_path", "write_loan_csv", "write_stage", "KEY", "LABEL", "LOAN_BOOK_SQL",
    "RAW_COLUMNS", "loan_book", "TABLES", "read_table", "table_path",
]
