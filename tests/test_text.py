import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.normalize_text, "Café & Söhne, GmbH", "cafe and sohne gmbh"),
        (T.normalize_text, None, ""),
        (T.clean_name, "Acme Pvt Ltd of S A R L", "acme of"),
        (T.clean_address, "12 Main St, CT; h.no 4", "12 main street court house number 4"),
        (T.domain_stem, "see https://www.shop.brand-x.co.in/a?b", "brand-x"),
        (T.domain_stem, "none here", ""),
        (T.state_token, "12 main st de 19901", "DE"),
        (T.pincode, "x 12345-6789 y", "12345"),
        (T.pincode, "no code", None),
        (T.is_missing, " NaN ", 1),
    ],
)
def test_scalar(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_premise_tokens(spark):
    assert set(one(spark, T.premise_tokens, "Plot No. 14/2, no. 007")) >= {"14/2", "14", "2", "007"}
    assert one(spark, T.premise_tokens, "") == []


def test_kernels():
    assert fuzzy.ratio("abc", "abd") == pytest.approx(2 / 3)
    assert fuzzy.token_sort("b a", "a b") == 1.0
    assert fuzzy.token_set("a b c", "a b") == 1.0
    assert fuzzy.token_set("", "a") == 0.0
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert fuzzy.jaro_winkler("", "") == 0.0
