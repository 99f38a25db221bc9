from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions import names as S
from dasyspark.functions import numbers as N


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_fold_drops_marks_and_collapses(spark):
    cases = {
        "  Écolé\t  Über Straße ": "ecole uber straße", "ﬁne ½": "fine 1⁄2", "éte": "ete",
        "Ａｂ１": "ab1", "Ñandú ΆЙ": "nandu αи", "": "",
    }
    for raw, want in cases.items():
        assert one(spark, raw, S.fold_name) == want


def test_every_assigned_character_decomposes(spark):
    """Alone and inside a text, for the whole character database; several expanding characters in a row too."""
    import unicodedata

    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    chars = [chr(p) for p in range(1, 0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    texts = chars + [f"a{c}b" for c in chars[::7]] + ["½각ﬁﷺ…각ㅏ", "힣가A각각", "㍿㎏½", "", "ñ́x", "𝒜𝟘ﬀ"]
    rows = spark.createDataFrame([(t, plain(t)) for t in texts], "raw string, want string").repartition(8)
    wrong = rows.withColumn("got", S.strip_marks(F.col("raw"))).where("NOT (got <=> want)")
    assert wrong.count() == 0, wrong.limit(5).collect()
    assert spark.createDataFrame([(None,)], "v string").select(S.strip_marks(F.col("v"))).first()[0] is None


def test_title_case_follows_letter_runs(spark):
    for raw in ("o'neil-smith 3rd s. madhopur", "north 24 parganas", "ABC dEF", "x"):
        assert one(spark, raw, S.title_case) == raw.title()


def test_alias_key_and_norm(spark):
    rows = spark.createDataFrame([("Mumbai#",), (" BOMBAY $",), ("Thane (R)*+",)], "raw string")
    aliases = spark.createDataFrame([("bombay", "Mumbai")], "alias string, canonical string")
    got = {r.raw: r.unit for r in S.norm_unit_name(rows, "raw", aliases).collect()}
    assert got == {"Mumbai#": "Mumbai", " BOMBAY $": "Mumbai", "Thane (R)*+": "Thane (R)"}


def test_numbers(spark):
    cases = {"₹ 2,28,623.5 Cr": 228623.5, "1e3": 1000.0, "-": None, ".": None, "": None, "abc": None, "e": None, None: None, "-5": -5.0, "1-2": None}
    for raw, want in cases.items():
        assert one(spark, raw, N.parse_inr_number) == want
    assert one(spark, "1e3", N.to_float_lenient) == 13.0
    assert one(spark, "12%", N.to_float_lenient) == 12.0


def test_slug_and_source_line(spark):
    assert one(spark, " Rae Bareli (É) ", S.slug) == "rae-bareli-e"
    assert one(spark, "###", S.slug) == "unknown"
    rows = spark.createDataFrame([("2023-24", "constant", "2011-12"), ("2023-24", "current", None), (None, None, None), ("2020-21", "", "x")], "y string, b string, a string")
    got = [r[0] for r in rows.select(S.source_line(F.col("y"), F.col("b"), F.col("a"))).collect()]
    assert got == ["FY 2023-24, constant prices (base 2011-12)", "FY 2023-24, current prices", "", "FY 2020-21"]


def test_round_half_even_and_quintiles(spark):
    assert one(spark, 2.5, lambda c: N.round_pack(c, "poi"), "double") == 2.0
    assert one(spark, 3.5, lambda c: N.round_pack(c, "g"), "double") == 4.0
    for value, want in ((0.0, 1), (20.0, 1), (20.0001, 2), (60.0, 3), (80.0, 4), (100.0, 5)):
        assert one(spark, value, N.bucket_quintile, "double") == want
    assert one(spark, None, N.bucket_quintile, "double") is None


def test_short_key_agrees_with_plan_time_twin(spark):
    for metric in ("population", "landuse_residential", "poi_amenity_guest_house", "poi_count", "anything"):
        assert one(spark, metric, N.short_key) == N.key_of(metric)


def test_activations(spark):
    assert abs(one(spark, 800.0, N.softplus, "double") - 800.0) < 1e-9
    assert one(spark, -800.0, N.softplus, "double") >= 0
    assert abs(one(spark, -1.0, N.elu, "double") + 0.6321205588285577) < 1e-12


def test_aliases_hold_within_their_territory(spark):
    rows = spark.createDataFrame([("MH", "Aurangabad"), ("BR", "Aurangabad")], "code string, raw string")
    found = {r.code: r.unit for r in S.norm_unit_name(rows, "raw", C.alias_table(spark)).collect()}
    assert found == {"MH": "Chhatrapati Sambhajinagar", "BR": "Aurangabad"}
