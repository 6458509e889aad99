"""SQL names for validators, masks and tokens."""

from __future__ import annotations

from pyspark.sql import SparkSession

from telemill.functions import checksums, text, tokens
from telemill.operators.envelope import time_allowed
from telemill.operators.detect import risk_score
from telemill.operators.quality import grade
from telemill.session import configure

# SQL name: (parameters, result type, fragment over the parameters).
FUNCTIONS = {
    "digits_only": ("s STRING", "STRING", checksums.digits_only("s")),
    "count_digits": ("s STRING", "INT", checksums.count_digits("s")),
    "valid_luhn": ("s STRING", "BOOLEAN", checksums.luhn("s")),
    "valid_tfn": ("s STRING", "BOOLEAN", checksums.valid_tfn("s")),
    "valid_abn": ("s STRING", "BOOLEAN", checksums.valid_abn("s")),
    "valid_acn": ("s STRING", "BOOLEAN", checksums.valid_acn("s")),
    "valid_medicare": ("s STRING", "BOOLEAN", checksums.valid_medicare("s")),
    "valid_ihi": ("s STRING", "BOOLEAN", checksums.valid_ihi("s")),
    "valid_iban": ("s STRING", "BOOLEAN", checksums.iban_valid("s")),
    "card_network": ("s STRING", "STRING", checksums.card_network("s")),
    "sha256_token": ("s STRING", "STRING", tokens.sha256_token("s")),
    "mask_middle": ("s STRING", "STRING", tokens.mask_middle("s")),
    "mask_email": ("s STRING", "STRING", tokens.mask_email("s")),
    "mask_card": ("s STRING", "STRING", tokens.mask_card("s")),
    "mask_digits": ("s STRING", "STRING", tokens.mask_digits("s")),
    "field_key": ("s STRING", "STRING", text.field_key("s")),
    "safe_stem": ("s STRING", "STRING", text.safe_stem("s")),
    "quality_grade": ("n INT", "STRING", grade("n")),
    "risk_score": ("level STRING", "INT", risk_score("level")),
    "time_allowed": ("ts TIMESTAMP, at TIMESTAMP", "BOOLEAN", time_allowed("ts", "at")),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions; their bodies are inlined, so they run as built-in expressions."""
    configure(spark)
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
