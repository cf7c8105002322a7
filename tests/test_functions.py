from pyspark.sql import functions as F

from tessera.functions import scoring, text


def run(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v"))).collect())]


def test_name_key(spark):
    rows = ["Acme Pvt. Ltd.", "ACME Co., Inc.", "Acme Private Limited", "Ltd.com Limited", "Élan  Corp", "co-op Co", "Private Limited X", "  Globex\tLLC ", "Ltd", None]
    assert run(spark, rows, text.name_key) == ["acme", "acme", "acme", "com", "lan", "op", "x", "globex", "", ""]


def test_title_case(spark):
    rows = ["o'neil", "ABC-def", "3com", "élan vital", " mcDONALD ", None]
    assert run(spark, rows, text.title_case) == ["O'Neil", "Abc-Def", "3Com", "Élan Vital", "Mcdonald", None]


def test_email(spark):
    rows = ["a@b.co", " a@b.co ", "a@-b..com", "a@b", "a b@c.com", "a@b.c", "", None]
    assert run(spark, rows, text.valid_email) == [True, True, True, False, False, False, False, False]


def test_lookups(spark):
    from tessera import config

    rows = ["tech", " Retail ", "Auto", None]
    assert run(spark, rows, lambda c: text.canonical(c, config.INDUSTRIES)) == ["Technology", "Retail", "Auto", None]
    rows = ["U.K.", "India", "india", "usa", None]
    assert run(spark, rows, lambda c: text.canonical(c, config.COUNTRIES)) == ["United Kingdom", "India", "india", "usa", None]
    assert run(spark, ["vp", "Chief Wizard", None], lambda c: text.from_list(c, config.JOB_TITLES, "Other")) == ["VP", "Other", "Other"]


def test_numbers_and_blanks(spark):
    assert run(spark, ["1.5", " 2 ", "12d", "1e3", "", "NaN", None], text.number) == [1.5, 2.0, None, 1000.0, None, None, None]
    assert run(spark, ["", " \t", "x", None, " "], text.blank) == [True, True, False, True, True]
    assert run(spark, ["(020) 123-4567", "123", None], text.phone_digits) == ["0201234567", None, None]


def test_buckets(spark):
    revenue = run(spark, [None, -1.0, 0.0, 1e6, 1e7, 1e8], scoring.revenue_bucket, "double")
    assert revenue == ["Unknown", "Unknown", "< 1M", "1M - 10M", "10M - 100M", "100M+"]
    sizes = run(spark, [None, 0.0, 100.0, 101.0, 1000.0, 1001.0], scoring.size_bucket, "double")
    assert sizes == ["Unknown", "Unknown", "Small", "Medium", "Medium", "Large"]
    assert run(spark, [90.0, 75.0, 60.0, 59.99], scoring.quality_band, "double") == ["Excellent", "Good", "Fair", "Poor"]
    assert run(spark, [90.0, 80.0, 70.0, 69.0], scoring.grade, "double") == ["A", "B", "C", "D"]
