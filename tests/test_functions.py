from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.functions import parsing as P
from ledgerloom.functions import scoring as S
from tests.conftest import values


def test_phone(spark):
    given_, want = zip(
        ("(415) 555-0142", "+14155550142"), ("+1 415 555 0142", "+14155550142"), ("00447911123456", "+447911123456"), ("123", None), (None, None), ("4.155550142E9", "+41555501429"), ("1" * 16, None), strict=True,
    )
    assert values(spark, N.phone_e164, given_) == list(want)


def test_country_and_skill(spark):
    assert values(spark, N.country, ["United States", "usa", "Atlantis", "UK", "uk ", "u.k."]) == ["US", "US", None, "UK", "UK", "GB"]
    assert values(spark, N.skill, ["golang", "k8s", "JS", "Foo.", "...", "Node.js.", "", None]) == ["Go", "Kubernetes", "JavaScript", "Foo.", None, "Node.js", None, None]


def test_date(spark):
    given_ = ["Jun 2017", "01/2020", "2021-3", "present", "garbage", "13/2020", "march 2020", "sept 2020", "junk 2020", "2020", "2020-01\n", None]
    assert values(spark, N.date_ym, given_) == ["2017-06", "2020-01", "2021-03", "present", None, "2020-13", None, "2020-09", "2020-06", "2020", "2020-01", None]


def test_email_and_text(spark):
    assert values(spark, N.email, [" A@b.com\n", "a@b", "x y@c.d", "a@b.com."]) == ["a@b.com", None, None, "a@b.com."]
    assert values(spark, N.text, ["  a \n b ", "", " \t ", None]) == ["a b", None, None, None]


def test_csv_fields(spark):
    assert values(spark, P.csv_fields, ['x""y', '"p""q"', 'a,"b, c",d', "", "a,", '"a"b,c', '"un,closed']) == [["xy"], ['p"q'], ["a", "b, c", "d"], [""], ["a", ""], ["ab", "c"], ["un,closed"]]


def test_sections_and_tokens(spark):
    assert values(spark, lambda x: P.section_lines(x, "skills"), ["pre\nSKILLS\na, b\nEducation:\nq\nskills\nc", "none", "Skills:\n"]) == [["c"], [], [""]]
    assert values(spark, lambda x: P.skill_tokens(F.split(x, "\n")), ["a, b/ c•d|.e-\n- f.", "x" * 31]) == [["a", "b", "c", "d", "e", "f"], []]
    assert values(spark, P.phrase_skills, ["Very strong in distributed systems, Go and Kafka.\nBackup", "none"]) == [["distributed systems", "Go", "Kafka"], []]
    assert values(spark, P.location_parts, ["San Francisco, CA", " , ", "Paris", "a,,b"]) == [["San Francisco", "CA"], [], ["Paris"], ["a", "b"]]


def test_json(spark):
    assert values(spark, lambda x: P.parse_json(x).isNull(), ['{"a":1}', '{"a":1} x', "{broken", "", "null", '{"a":1},{"b":2}', None]) == [False, True, True, True, False, True, True]
    doc = '{"n":9,"s":"","l":[],"l2":["x",3,null],"z":null,"sc":"one"}'
    assert values(spark, lambda x: P.as_text(P.first_of(P.parse_json(x), "z", "s", "l", "missing", "n")), [doc]) == ["9.0"]
    assert values(spark, lambda x: F.transform(P.as_list(P.child(P.parse_json(x), "l2")), P.as_text), [doc]) == [["x", "3.0", None]]
    assert values(spark, lambda x: P.string_only(P.child(P.parse_json(x), "n")), [doc]) == [None]


def test_scores(spark):
    row = spark.range(1).select(S.round3(F.lit(0.5005)).alias("a"), S.scalar_confidence(F.lit(0.9), F.lit(4), F.lit(0)).alias("b"), S.scalar_confidence(F.lit(0.9), F.lit(1), F.lit(4)).alias("c"), S.skill_confidence(F.lit(0.7), F.lit(3)).alias("d")).first()
    assert tuple(row) == (0.5, 1.0, 0.58, 0.86)
    assert values(spark, S.recency_key, ["2026", "2026-06", ""])[0] < values(spark, S.recency_key, ["2026-06"])[0]


def test_sql_functions(spark):
    N.register_sql(spark)
    assert tuple(spark.sql("SELECT norm_e164('(415) 555-0142'), norm_country('usa'), norm_date('Jun 2017'), norm_canonical('k8s')").first()) == ("+14155550142", "US", "2017-06", "Kubernetes")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_normalizers_are_idempotent(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for name in ("email", "E164", "country", "canonical", "name", "text"):
        once = values(spark, N.REGISTRY[name], texts)
        assert values(spark, N.REGISTRY[name], once) == once
