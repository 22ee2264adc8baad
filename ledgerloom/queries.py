"""Queries of the engine's operators over the driver tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L
from ledgerloom.functions import normalize as N
from ledgerloom.functions import parsing as P
from ledgerloom.functions.text import find_distinct
from ledgerloom.operators import canonical as C
from ledgerloom.operators import merge as M
from ledgerloom.operators.ledger import build_ledger, default_trust, extract, field_trust, source_log
from ledgerloom.plans.json_text import json_text
from ledgerloom.plans.projection import project, project_json
from ledgerloom.sources.adapters import draft, education, experience, registry
from ledgerloom.sources.manifests import latest_of, read_documents, read_manifests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_map(mapping: dict[str, str], key: str) -> str:
    """A CASE over a dictionary's entries."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + " END"


_PHONE_SQL = """CASE WHEN length(d) BETWEEN 7 AND 15 THEN CASE WHEN plus THEN '+' || d WHEN length(d) = 10 THEN '+1' || d ELSE '+' || d END END"""


def _phones(found: str) -> str:
    return f"""
    SELECT id, raw, {_PHONE_SQL} AS phone FROM (
      SELECT id, raw, (starts_with(raw, '+') OR starts_with(raw, '00')) AS plus,
        CASE WHEN starts_with(raw, '00') THEN substr(regexp_replace(raw, '\\D', '', 'g'), 3) ELSE regexp_replace(raw, '\\D', '', 'g') END AS d
      FROM (SELECT DISTINCT id, raw FROM ({found})))
    """


# ---- scalar functions ----


@query(r"""
SELECT doc_id, raw, CASE WHEN regexp_full_match(lower(trim(raw)), '[^@\s]+@[^@\s]+\.[^@\s]+') THEN lower(trim(raw)) END AS email
FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+')) AS raw FROM documents)
""")
def q_email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.explode(find_distinct(F.col("text"), L.FIND_EMAIL)).alias("raw"))
    return raw.select("doc_id", "raw", N.email(F.col("raw")).alias("email"))


@query(
    _phones(r"""SELECT 'd' || doc_id AS id, unnest(regexp_extract_all(text, '\+?\d[\d\s().-]{7,}\d')) AS raw FROM documents
    UNION ALL SELECT 'p' || page_id, unnest(regexp_extract_all(html, '\+?\d[\d\s().-]{7,}\d')) FROM pages""")
)
def q_phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    raw = docs.unionByName(pages).select("id", F.explode(find_distinct(F.col("text"), L.FIND_PHONE)).alias("raw"))
    return raw.select("id", "raw", N.phone_e164(F.col("raw")).alias("phone"))


@query(r"""SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS clean FROM documents""")
def q_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.text(F.col("text")).alias("clean"))


@query(r"""SELECT c_custkey, nullif(trim(regexp_replace('  ' || replace(c_name, '#', chr(9) || ' ') || ' ', '\s+', ' ', 'g')), '') AS name FROM customer""")
def q_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("\t ")), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", N.name(spaced).alias("name"))


_COUNTRY_SQL = lambda x: f"CASE WHEN regexp_full_match(trim({x}), '[A-Za-z]{{2}}') THEN upper(trim({x})) ELSE {_sql_map(L.COUNTRIES, f'lower(trim({x}))')} END"
_PLACES = ["UK", "uk ", "u.k.", "Atlantis", "de", "Deutschland", "", "U.S."]


@query(
    f"""SELECT x, {_COUNTRY_SQL("x")} AS country FROM (SELECT n_name AS x FROM nation UNION ALL SELECT unnest({_PLACES!r}))"""
)
def q_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(p,) for p in _PLACES], "x string")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("x")).unionByName(more).select("x", N.country(F.col("x")).alias("country"))


_SKILL_SQL = lambda x: f"CASE WHEN regexp_replace(lower(trim({x})), '\\.+$', '') <> '' THEN coalesce({_sql_map(L.SKILLS, f'''regexp_replace(lower(trim({x})), '\\.+$', '')''')}, trim({x})) END"
_SKILLS = ["golang", "k8s", "JS", "Foo.", "...", "Node.js.", " c++ ", "Machine Learning", "Quantum"]


@query(
    f"""SELECT x, {_SKILL_SQL("x")} AS skill, count(*)::BIGINT AS n
    FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part UNION ALL SELECT unnest({_SKILLS!r})) GROUP BY ALL"""
)
def q_skill_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("x"))
    more = spark.createDataFrame([(s,) for s in _SKILLS], "x string")
    return words.unionByName(more).groupBy("x").agg(F.count("*").alias("n")).select("x", N.skill(F.col("x")).alias("skill"), "n")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m')
  WHEN 3 THEN strftime(o_orderdate, '%Y') END AS ym FROM orders""")
def q_date_ym(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-M"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "M/yyyy"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "MMM. yyyy"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(day, " yyyy "))
        .otherwise(F.date_format(day, "MM-dd"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", N.date_ym(spelled).alias("ym"))


_EDGES = ["(555) 010-99", "13/2020", "march 2020", "sept 2020", "junk 2020", "present", "Ongoing", "2020-3", "x"]


@query(
    """SELECT * FROM (VALUES ('(555) 010-99', NULL), ('13/2020', '2020-13'), ('march 2020', NULL), ('sept 2020', '2020-09'), ('junk 2020', '2020-06'),
  ('present', 'present'), ('Ongoing', 'present'), ('2020-3', '2020-03'), ('x', NULL)) t(x, ym)"""
)
def q_date_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e,) for e in _EDGES], "x string").select("x", N.date_ym(F.col("x")).alias("ym"))


@query(
    f"""WITH t AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' City,  ' || n_name ELSE n_name || ', ' || r_name || ' ,, ' || r_name END AS loc
      FROM nation JOIN region ON n_regionkey = r_regionkey),
    s AS (SELECT n_nationkey, list_transform(list_filter(string_split(loc, ','), lambda p: trim(p) <> ''), lambda p: trim(p)) AS p FROM t),
    u AS (SELECT n_nationkey, p, len(p) AS n, p[-1] AS l, {_COUNTRY_SQL("p[-1]")} AS cc FROM s)
    SELECT n_nationkey, CASE WHEN n > 2 OR cc IS NOT NULL THEN 'location.country' WHEN n = 1 THEN 'location.city' ELSE 'location.region' END AS field_path, coalesce(cc, l) AS value FROM u
    UNION ALL SELECT n_nationkey, 'location.city', p[1] FROM u WHERE n > 1 UNION ALL SELECT n_nationkey, 'location.region', p[2] FROM u WHERE n > 2"""
)
def q_location_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.sources.adapters import location_drafts, location_stages

    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spelled = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit(" City,  "), "n_name"))
    rows = rows.select("n_nationkey", spelled.otherwise(F.concat("n_name", F.lit(", "), "r_name", F.lit(" ,, "), "r_name")).alias("loc"))
    for stage in location_stages("loc", "spot"):
        rows = rows.withColumns(stage)
    usable, drafts = location_drafts("loc", "spot", "test")
    return rows.where(usable).select("n_nationkey", F.explode(drafts).alias("d")).select("n_nationkey", "d.field_path", F.col("d.value_str").alias("value"))


_LINKS = ["https://www.LinkedIn.com/in/x", " http://github.com/y ", "https://example.org"]


@query(
    f"""SELECT u, CASE WHEN lower(u) LIKE '%linkedin.com%' THEN 'links.linkedin' WHEN lower(u) LIKE '%github.com%' THEN 'links.github' ELSE 'links.other' END AS field_path
    FROM (SELECT url AS u FROM pages UNION ALL SELECT unnest({_LINKS!r}) UNION ALL SELECT 'https://github.com/' || page_id FROM pages)"""
)
def q_link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    urls = pages.select(F.col("url").alias("u")).union(spark.createDataFrame([(u,) for u in _LINKS], "u string")).union(pages.select(F.concat(F.lit("https://github.com/"), F.col("page_id").cast("string"))))
    return urls.select("u", P.link_field(F.col("u")).alias("field_path"))


@query(r"""
SELECT doc_id, token, count(*)::BIGINT AS n FROM (
  SELECT doc_id, regexp_replace(regexp_replace(trim(t, ' ' || chr(9) || chr(13)), '^[.\-\s]+', ''), '[.\-\s]+$', '') AS token FROM (
    SELECT doc_id, unnest(regexp_split_to_array(line, ',|/|•|\|')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)))
WHERE token <> '' AND length(token) <= 30 GROUP BY ALL
""")
def q_skill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return lines.select("doc_id", F.explode(P.skill_tokens(F.col("lines"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(r"""
SELECT p_partkey, unnest(s) AS skill FROM (
  SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ', also ' || p_brand, ',|/| and '), lambda t: trim(regexp_replace(regexp_replace(trim(t), '[.\s]+$', ''), '(?i)^(also|and|or|the|with|in)\s+', ''))),
    lambda t: t <> '' AND length(t) <= 30) AS s FROM part)
""")
def q_skill_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("Met them. Strong in "), "p_name", F.lit(", also "), "p_brand", F.lit("! skills: none"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(P.phrase_skills(note)).alias("skill"))


@query("""
WITH lines AS (SELECT conv_id, turn, n, l FROM (SELECT conv_id, turn, unnest(t) AS l, generate_subscripts(t, 1) AS n FROM (
    SELECT conv_id, turn, string_split('pre' || chr(10) || 'SKILLS' || chr(10) || text || chr(10) || 'Education:' || chr(10) || role || chr(10) || ' technical skills ' || chr(10) || conv_id || chr(10) || text, chr(10)) AS t
    FROM conversations WHERE text IS NOT NULL))),
heads AS (SELECT *, CASE WHEN rtrim(lower(trim(l)), ':') IN ('skills', 'technical skills') THEN 'skills' WHEN rtrim(lower(trim(l)), ':') IN ('experience', 'work experience', 'employment') THEN 'experience'
  WHEN rtrim(lower(trim(l)), ':') = 'education' THEN 'education' END AS kind FROM lines),
marked AS (SELECT *, max(CASE WHEN kind IS NOT NULL THEN n END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS head FROM heads),
named AS (SELECT m.*, h.kind AS section FROM marked m JOIN heads h ON h.conv_id = m.conv_id AND h.turn = m.turn AND h.n = m.head),
latest AS (SELECT conv_id, turn, section, max(head) AS head FROM named GROUP BY ALL)
SELECT conv_id, turn, section, string_agg(l, chr(10) ORDER BY n) AS body FROM named JOIN latest USING (conv_id, turn, section, head) WHERE kind IS NULL GROUP BY ALL
""")
def q_section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    nl = F.lit("\n")
    whole = F.concat(F.lit("pre\nSKILLS\n"), "text", nl, F.lit("Education:"), nl, "role", nl, F.lit(" technical skills "), nl, F.col("conv_id").cast("string"), nl, "text")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", whole.alias("text"))
    one = lambda s: F.struct(F.lit(s).alias("section"), F.array_join(P.lines_under(F.col("sections"), s), "\n").alias("body"))
    return rows.withColumn("sections", P.sections(F.col("text"))).select("conv_id", "turn", F.explode(F.array(*(one(s) for s in ("skills", "experience", "education")))).alias("s")).select("conv_id", "turn", "s.section", "s.body").where("body <> ''")


@query("""SELECT c_custkey, 1 + generate_subscripts(f, 1) - 1 AS pos, unnest(f) AS field FROM (
  SELECT c_custkey, [c_custkey::VARCHAR, 'a, "' || c_name || '"', 'xy', c_mktsegment, ''] AS f FROM customer)""")
def q_csv_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"a, ""'), "c_name", F.lit('""",x""y,"'), "c_mktsegment", F.lit('",'))
    fields = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(P.csv_fields(line)).alias("pos", "field"))
    return fields.select("c_custkey", (F.col("pos") + 1).cast("long").alias("pos"), "field")


# ---- JSON ----


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE (props->>'$.k') || '.0' END AS first FROM events""")
def q_json_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"a":"","b":[],"c":null,"d":'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.lit("null")), F.lit(',"e":'), F.get_json_object("props", "$.k"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", P.parse_json(text).alias("doc"))
    return rows.select("event_id", P.as_text(P.first_of(F.col("doc"), "z", "a", "b", "c", "d", "e")).alias("first"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN (props->>'$.k') || '.0' WHEN 1 THEN (props->>'$.k') || '.0|' || event_type ELSE '' END AS items FROM events""")
def q_json_aslist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), k, F.lit(',null,"'), "event_type", F.lit('"]'))).otherwise(F.lit("null"))
    rows = table(spark, sf_dir, "events").select("event_id", P.parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))).alias("doc"))
    return rows.select("event_id", F.array_join(F.transform(P.as_list(P.child(F.col("doc"), "v")), P.as_text), "|").alias("items"))


@query("""SELECT user_id::VARCHAR AS candidate_id, event_id AS pos, event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS ok,
  CASE WHEN event_id % 7 = 0 THEN 'unknown source type ''fax''' WHEN event_id % 4 = 0 THEN 'extract failed: not a JSON value' WHEN event_id % 5 = 0 THEN 'read failed: p' END AS error,
  CASE WHEN event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 THEN 1 ELSE 0 END AS claims FROM events""")
def q_json_sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    content = F.when(e % 4 == 0, F.concat("props", F.lit(" trailing"))).when(e % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit('{"bio":"'), "event_type", F.lit('"}')))
    documents = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("candidate_id"), e.cast("long").alias("pos"), F.when(e % 7 == 0, "fax").otherwise("github_api").alias("type"), F.lit("p").alias("path"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("double").alias("trust"), content.alias("content")
    )
    return source_log(extract(documents, registry("github_api"))).select("candidate_id", "pos", "ok", "error", "claims")


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '\\n\\"q\\"","total":' ||
  (CASE WHEN floor(o_totalprice) = o_totalprice THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END) || ',"half":' || (o_orderkey // 2)::VARCHAR || (CASE WHEN o_orderkey % 2 = 1 THEN '.5' ELSE '' END) || ',"none":null,"list":["' || o_orderpriority || '",[]]}' AS json FROM orders""")
def q_json_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.concat("o_orderstatus", F.lit('\n"q"')).alias("status"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_orderkey") / 2.0).alias("half"),
        F.lit(None).cast("string").alias("none"),
    )
    priority = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    rows = rows.join(priority, "key")
    body = F.struct("key", "status", "total", "half", "none")
    text = json_text(body, rows.select(body.alias("b")).schema["b"].dataType)
    tail = F.concat(F.lit(',"list":["'), "o_orderpriority", F.lit('",'), json_text(F.array().cast("array<string>"), rows.select(F.array().cast("array<string>").alias("b")).schema["b"].dataType), F.lit("]}"))
    return rows.select(F.col("key").alias("o_orderkey"), F.concat(F.regexp_replace(text, r"\}$", ""), tail).alias("json"))


# ---- the ledger ----

_TRUST = {"purchase": 0.90, "signup": 0.85, "click": 0.75, "view": 0.60, "error": 0.40}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as if it were a source's document: many sources of one type a candidate."""
    trust = F.coalesce(*(F.when(F.col("event_type") == s, F.lit(v)) for s, v in _TRUST.items()))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("candidate_id"),
        F.col("event_type").alias("source_id"),
        trust.alias("trust"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.date_format("ts", "yyyy-MM-dd").alias("observed_at"),
        F.col("event_id").alias("src_order"),
    )


_EVENTS_SQL = f"""le AS (SELECT user_id::VARCHAR AS candidate_id, event_type AS source_id, CASE event_type {" ".join(f"WHEN '{s}' THEN {v}::DOUBLE" for s, v in _TRUST.items())} END AS trust,
    (props->>'$.k')::BIGINT AS k, strftime(ts, '%Y-%m-%d') AS observed_at, event_id AS src_order FROM events)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of many fields, derived from each event's k; dealt by candidate once, so that no reduction exchanges them again."""
    k = F.col("k")
    t = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    role = experience(t("Co", 2), t("Role", 2), F.when(k % 3 == 0, F.concat(F.lit("20"), F.lpad((k % 20).cast("string"), 2, "0"))), F.lit("present"), F.when(k % 4 == 0, t("sum", 5)))
    study = education(t("Uni", 2), F.lit("BSc"), F.when(k % 2 == 0, t("Field", 3)), F.when(k % 3 == 1, 2000 + k % 20))
    drafts = F.array(
        draft("full_name", t("T", 3), "m:name", t("T", 3)),
        draft("headline", t("H", 2), "m:head", F.when(k % 5 != 0, t("H", 2))),
        draft("years_experience", k.cast("string"), "m:years", number=(k % 4).cast("double")),
        draft("location.country", t("C", 2), "m:country", t("C", 2)),
        draft("emails", t("E", 4), "m:email", F.when(k % 2 == 0, F.upper(t("e", 4))).otherwise(t("e", 4))),
        draft("skills", t("S", 3), "m:skill", F.when(k % 2 == 0, F.upper(t("skill", 3))).otherwise(t("skill", 3))),
        draft("experience", t("x", 9), "m:role", experience=role),
        draft("education", t("x", 9), "m:study", education=study),
    )
    rows = _events(spark, sf_dir).select("candidate_id", "source_id", "trust", "observed_at", "src_order", F.posexplode(drafts).alias("claim_seq", "d"))
    return rows.select("candidate_id", "d.*", "source_id", "trust", "observed_at", "src_order", "claim_seq").repartition("candidate_id")


@query("""SELECT 'c' || c_custkey AS id, unnest(['full_name', 'location.country', 'years_experience']) AS field_path, unnest([c_name, n_name, NULL]) AS value_str, unnest([NULL, NULL, c_acctbal]) AS value_num FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, unnest(['full_name', 'location.country', 'years_experience']), unnest([s_name, n_name, NULL]), unnest([NULL, NULL, s_acctbal]) FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_unpivot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")

    def claims(name: str, mark: str) -> DataFrame:
        rows = table(spark, sf_dir, name).join(nation, F.col(f"{mark}_nationkey") == F.col("key"))
        key = f"{mark}_custkey" if mark == "c" else f"{mark}_suppkey"
        made = F.array(
            draft("full_name", F.col(f"{mark}_name"), "t", F.col(f"{mark}_name")),
            draft("location.country", F.col("n_name"), "t", F.col("n_name")),
            draft("years_experience", F.col("n_name"), "t", number=F.col(f"{mark}_acctbal")),
        )
        return rows.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.explode(made).alias("d")).select("id", "d.field_path", "d.value_str", "d.value_num")

    return claims("customer", "c").unionByName(claims("supplier", "s"))


_KINDS = [*L.DEFAULT_TRUST, "fax"]
_FIELDS = ["skills", "links.github", "phones", "headline", "experience", "skills.extra", "full_name"]


@query(
    f"""WITH s AS (SELECT event_id, ({_KINDS!r})[1 + event_id % 7] AS type, ({_FIELDS!r})[1 + (event_id // 7) % 7] AS field_path, CASE WHEN event_id % 3 = 0 THEN value END AS given FROM events),
    o AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for (a, b), v in L.FIELD_TRUST.items())}) t(type, field, v))
    SELECT event_id, coalesce(a.v, b.v, given, CASE s.type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in L.DEFAULT_TRUST.items())} ELSE 0.5 END)::DOUBLE AS trust
    FROM s LEFT JOIN o a ON a.type = s.type AND a.field = s.field_path LEFT JOIN o b ON b.type = s.type AND b.field = string_split(s.field_path, '.')[1]"""
)
def q_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", pick(_KINDS, e).alias("type"), pick(_FIELDS, F.floor(e / 7)).alias("field"), F.when(e % 3 == 0, F.col("value")).alias("given"))
    return rows.select("event_id", field_trust(F.col("type"), F.coalesce("given", default_trust(F.col("type"))), F.col("field")).alias("trust"))


@query("""SELECT user_id, event_id, coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS src_order FROM events""")
def q_src_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 3 != 0).alias("ok"))
    return latest_of(rows).select(F.col("candidate_id").alias("user_id"), F.col("pos").alias("event_id"), "src_order")


@query("""SELECT event_type AS type, count(*)::BIGINT AS skipped, min('unknown source type ''' || event_type || '''') AS error FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type""")
def q_unknown_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = registry("recruiter_notes", "resume")
    known = {"click": made["recruiter_notes"], "view": made["resume"]}
    null = lambda kind: F.lit(None).cast(kind)
    documents = table(spark, sf_dir, "events").select(F.lit("x").alias("candidate_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("type"), F.lit("p").alias("path"), null("string").alias("timestamp"), null("double").alias("trust"), F.lit("text").alias("content"))
    failed = source_log(extract(documents, known)).where(~F.col("ok"))
    return failed.groupBy("type").agg(F.count("*").alias("skipped"), F.min("error").alias("error"))


# ---- adapters, over documents made from the customer table ----


def _documents(spark: SparkSession, sf_dir: str, kind: str, content: Column) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").withColumn("key", F.col("c_custkey").cast("string"))
    return rows.select(F.col("key").alias("candidate_id"), F.lit(0).alias("pos"), F.lit(kind).alias("type"), F.lit("p").alias("path"), F.lit("2026-01-01").alias("timestamp"), F.lit(None).cast("double").alias("trust"), content.alias("content"))


def _claims(documents: DataFrame, kind: str) -> DataFrame:
    value = F.coalesce("value_str", F.col("value_num").cast("string"), F.concat_ws("|", *(F.coalesce(f"value_exp.{a}", F.lit("-")) for a in ("company", "title", "start", "end", "summary"))), F.lit("-"))
    studied = F.concat_ws("|", *(F.coalesce(F.col(f"value_edu.{a}").cast("string"), F.lit("-")) for a in ("institution", "degree", "field", "end_year")))
    value = F.when(F.col("value_edu").isNotNull(), studied).when(F.col("value_exp").isNotNull() | F.col("value_str").isNotNull() | F.col("value_num").isNotNull(), value)
    return build_ledger(extract(documents, registry(kind))).select("candidate_id", "claim_seq", "field_path", value.alias("value"), "method", "trust")


def _claims_sql(kind: str, items: list[tuple[str, str, str]]) -> str:
    """Rows (field, value, method) of every customer, in order."""
    trust = lambda f: L.FIELD_TRUST.get((kind, f), L.DEFAULT_TRUST[kind])
    rows = [f"SELECT c_custkey::VARCHAR AS candidate_id, {i} AS claim_seq, '{f}' AS field_path, {v} AS value, '{m}' AS method, {trust(f)}::DOUBLE AS trust FROM customer JOIN nation ON c_nationkey = n_nationkey" for i, (f, v, m) in enumerate(items)]
    return " UNION ALL ".join(rows)


@query(
    _claims_sql(
        "recruiter_csv",
        [("full_name", "c_name", "csv_column:name"), ("emails", "'u' || c_custkey || '@x.org'", "csv_column:email"), ("phones", "'+1' || (4000000000 + c_custkey)", "csv_column:phone")]
        + [("experience", "c_mktsegment || '|-|-|present|-'", "csv_row:current_role"), ("location.city", "n_name || ' City'", "csv_column:location"), ("location.region", "c_mktsegment", "csv_column:location")],
    )
)
def q_adapter_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("Name,EMAIL ,phone,current_company,title,location\n\n"), "c_name", F.lit(" ,U"), "key", F.lit('@X.org,"'), (F.col("c_custkey") + 4000000000).cast("string"), F.lit('",'), "c_mktsegment", F.lit(',,"'), "n_name", F.lit(" City, "), "c_mktsegment", F.lit('"\nnext,row'))
    return _claims(_documents(spark, sf_dir, "recruiter_csv", content), "recruiter_csv")


@query(
    _claims_sql(
        "ats_json",
        [("full_name", "c_name", "ats:candidateName"), ("emails", "'u' || c_custkey || '@x.org'", "ats:contactEmails"), ("emails", "NULL", "ats:contactEmails"), ("phones", "'+41555501429'", "ats:contactPhones"), ("headline", "c_mktsegment", "ats:currentHeadline")]
        + [("years_experience", "(c_custkey % 50)::VARCHAR || '.0'", "ats:yearsOfExperience"), ("location.city", "n_name", "ats:geo.city"), ("skills", "'Go'", "ats:skillTags"), ("skills", "c_mktsegment", "ats:skillTags"), ("links.other", "'https://x.org/' || c_custkey", "ats:profileUrls")],
    )
)
def q_adapter_ats(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(
        F.lit('{"candidateName":"","fullName":"'), "c_name", F.lit('","emails":["U'), "key", F.lit('@x.org","nope",null],"phone":4155550142,"headline":" '), "c_mktsegment", F.lit(' ","yoe":'), (F.col("c_custkey") % 50).cast("string"),
        F.lit(',"geo":{"town":"'), "n_name", F.lit('"},"skillTags":["golang",3,"'), "c_mktsegment", F.lit('"],"links":["https://x.org/'), "key", F.lit('"]}'),
    )
    return _claims(_documents(spark, sf_dir, "ats_json", content), "ats_json")


@query(
    _claims_sql(
        "github_api",
        [("full_name", "c_name", "github_api:name"), ("links.github", "'https://github.com/' || c_custkey || '.0'", "github_api:login"), ("headline", "NULL", "github_api:bio"), ("links.linkedin", "'https://linkedin.com/' || c_custkey", "github_api:blog")]
        + [("location.city", "n_name", "github_api:location"), ("location.country", "'US'", "github_api:location"), ("skills", "'JavaScript'", "github_api:languages")],
    )
)
def q_adapter_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit('{"name":"'), "c_name", F.lit('","login":'), "key", F.lit(',"bio":7,"blog":"https://linkedin.com/'), "key", F.lit('","location":"'), "n_name", F.lit(', USA","languages":"js"}'))
    return _claims(_documents(spark, sf_dir, "github_api", content), "github_api")


@query(
    _claims_sql(
        "linkedin",
        [("full_name", "c_name", "linkedin:name"), ("links.linkedin", "'https://l/' || c_custkey", "linkedin:profileUrl"), ("experience", "c_mktsegment || '|Boss|2017-06|present|-'", "linkedin:experience")]
        + [("education", "n_name || '|BSc|-|2017'", "linkedin:education"), ("skills", "'Kubernetes'", "linkedin:skills")],
    )
)
def q_adapter_linkedin(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(
        F.lit('{"name":"'), "c_name", F.lit('","profileUrl":" https://l/'), "key", F.lit('","experience":[{"company":"'), "c_mktsegment", F.lit('","title":"Boss","start":"Jun 2017","end":""},5],"education":{"school":"'), "n_name",
        F.lit('","institution":"no","degree":"BSc","end_year":2017},"skills":["k8s"," "]}'),
    )
    return _claims(_documents(spark, sf_dir, "linkedin", content), "linkedin")


@query(
    _claims_sql(
        "resume",
        [("emails", "'u' || c_custkey || '@x.org'", "resume:regex_email"), ("phones", "'+4915112345678'", "resume:regex_phone"), ("full_name", "'Ann Example'", "resume:first_line"), ("skills", "'Go'", "resume:skills_section"), ("skills", "c_mktsegment", "resume:skills_section")]
        + [("experience", "c_mktsegment || '|Boss|2021-03|present|-'", "resume:experience_section"), ("education", "n_name || '|BSc|Maths|2017'", "resume:education_section")],
    )
)
def q_adapter_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(
        F.lit("\n Ann Example \nU"), "key", F.lit("@x.org, 0049 151 12345678\nSkills:\nold\nEXPERIENCE\n• Boss, "), "c_mktsegment", F.lit(" (2021-03 to present)\nnothing\nEducation\nBSc in Maths, "), "n_name", F.lit(", 2017\nTechnical Skills\n- golang / "), "c_mktsegment", F.lit("."),
    )
    return _claims(_documents(spark, sf_dir, "resume", content), "resume")


@query(
    _claims_sql(
        "recruiter_notes",
        [("phones", "'+14155550199'", "notes:regex_phone"), ("emails", "'u' || c_custkey || '@x.org.'", "notes:regex_email"), ("skills", "c_mktsegment", "notes:skill_phrase"), ("skills", "'Apache Kafka'", "notes:skill_phrase")],
    )
)
def q_adapter_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("Write to U"), "key", F.lit("@x.org. Backup 415-555-0199 and 12345678901234567890. Expertise in "), "c_mktsegment", F.lit(" and the Kafka.! Skills: none"))
    return _claims(_documents(spark, sf_dir, "recruiter_notes", content), "recruiter_notes")


# ---- reductions ----

_WIN_SQL = f"""{_EVENTS_SQL}, claims AS (
    SELECT candidate_id, source_id, trust, observed_at, src_order, 'full_name' AS field_path, 'T' || (k % 3) AS value, NULL::DOUBLE AS num, 'm:name' AS method, 0 AS claim_seq FROM le
    UNION ALL SELECT candidate_id, source_id, trust, observed_at, src_order, 'headline', CASE WHEN k % 5 <> 0 THEN 'H' || (k % 2) END, NULL, 'm:head', 1 FROM le
    UNION ALL SELECT candidate_id, source_id, trust, observed_at, src_order, 'years_experience', (k % 4)::DOUBLE::VARCHAR, (k % 4)::DOUBLE, 'm:years', 2 FROM le
    UNION ALL SELECT candidate_id, source_id, trust, observed_at, src_order, 'location.country', 'C' || (k % 2), NULL, 'm:country', 3 FROM le),
  winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, field_path ORDER BY trust DESC, observed_at DESC, src_order, value, claim_seq) AS rn FROM claims WHERE value IS NOT NULL) WHERE rn = 1),
  counted AS (SELECT w.candidate_id, w.field_path, count(DISTINCT CASE WHEN c.value = w.value THEN c.source_id END) AS agreed, count(DISTINCT CASE WHEN c.value <> w.value THEN c.source_id END) AS conflicted
    FROM winners w JOIN claims c ON c.candidate_id = w.candidate_id AND c.field_path = w.field_path AND c.value IS NOT NULL GROUP BY ALL),
  scalars AS (SELECT w.*, agreed, conflicted, floor(greatest(0, least(1, trust + 0.12 * (1 - pow(0.6, agreed - 1)) / 0.4 - 0.08 * conflicted)) * 1000 + 0.5 + 1e-9) / 1000 AS confidence
    FROM winners w JOIN counted USING (candidate_id, field_path))"""


@query(f"WITH {_WIN_SQL} SELECT candidate_id, field_path, value, source_id AS winning_source, method FROM scalars")
def q_scalar_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.coalesce("value_str", F.col("value_num").cast("string")).alias("value")
    return M.resolve_scalars(_ledger(spark, sf_dir)).where("winning_source IS NOT NULL").select("candidate_id", "field_path", value, "winning_source", "method")


@query(f"WITH {_WIN_SQL} SELECT candidate_id, field_path, agreed::INTEGER AS agreed, conflicted::INTEGER AS conflicted, confidence FROM scalars")
def q_scalar_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolve_scalars(_ledger(spark, sf_dir)).where("winning_source IS NOT NULL").select("candidate_id", "field_path", "agreed", "conflicted", "confidence")


@query("""
WITH found AS (SELECT source, doc_id, pos, raw FROM (SELECT source, doc_id, unnest(m) AS raw, generate_subscripts(m, 1) AS pos FROM (SELECT source, doc_id, regexp_extract_all(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+') AS m FROM documents))),
firsts AS (SELECT *, row_number() OVER (PARTITION BY source, lower(raw) ORDER BY doc_id, pos) AS rn FROM found)
SELECT source AS candidate_id, string_agg(raw, '|' ORDER BY doc_id, pos) AS emails FROM firsts WHERE rn = 1 GROUP BY source
""")
def q_dedup_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(L.FIND_EMAIL), F.lit(0))).alias("claim_seq", "raw"))
    ledger = found.select(F.col("source").alias("candidate_id"), F.lit("emails").alias("field_path"), F.col("raw").alias("value_str"), F.lit("s").alias("source_id"), F.lit("m").alias("method"), F.lit(0.5).alias("trust"), F.col("doc_id").alias("src_order"), "claim_seq")
    return M.dedup_lists(ledger).select("candidate_id", F.array_join("values", "|").alias("emails"))


@query("""
WITH words AS (SELECT p_brand, p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS w FROM part)),
claims AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(word) ELSE word END AS value, 's' || (p_partkey % 3) AS source, CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 ELSE 0.6 END AS trust, p_partkey AS src_order, pos FROM words),
g AS (SELECT p_brand, lower(value) AS folded, count(DISTINCT source) AS n, max(trust) AS best, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM claims GROUP BY ALL),
d AS (SELECT * FROM (SELECT p_brand, lower(value) AS folded, value AS name, row_number() OVER (PARTITION BY p_brand, lower(value) ORDER BY trust DESC, value) AS rn FROM claims) WHERE rn = 1)
SELECT p_brand AS candidate_id, name, sources, floor(least(1, best + 0.1 * (1 - pow(0.6, n - 1)) / 0.4) * 1000 + 0.5 + 1e-9) / 1000 AS confidence FROM g JOIN d USING (p_brand, folded)
""")
def q_skill_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.posexplode(F.split("p_name", " ")).alias("claim_seq", "word"))
    k = F.col("p_partkey")
    ledger = words.select(
        F.col("p_brand").alias("candidate_id"), F.lit("skills").alias("field_path"), F.when(k % 2 == 0, F.upper("word")).otherwise(F.col("word")).alias("value_str"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_id"),
        F.lit("m").alias("method"), F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 0.7).otherwise(0.6).alias("trust"), k.alias("src_order"), "claim_seq",
    )
    skills = M.fold_skills(ledger).select("candidate_id", F.explode("skills").alias("s"))
    return skills.select("candidate_id", "s.name", F.array_join("s.sources", ",").alias("sources"), "s.confidence")


_RECORDS_SQL = f"""{_EVENTS_SQL}, roles AS (SELECT candidate_id, source_id, trust, src_order, 'Co' || (k % 2) AS company, 'Role' || (k % 2) AS title, CASE WHEN k % 3 = 0 THEN '20' || lpad((k % 20)::VARCHAR, 2, '0') END AS start, CASE WHEN k % 4 = 0 THEN 'sum' || (k % 5) END AS summary FROM le),
  merged AS (SELECT candidate_id, lower(company) AS c, lower(title) AS t, min_by(start, struct_pack(a := -trust, b := src_order)) FILTER (WHERE start IS NOT NULL) AS start,
    min_by(summary, struct_pack(a := -trust, b := src_order)) FILTER (WHERE summary IS NOT NULL) AS summary, min_by(source_id, struct_pack(a := -trust, b := src_order)) AS source, min(struct_pack(a := -trust, b := src_order)) AS rank, min_by(company, struct_pack(a := -trust, b := src_order)) AS company, min_by(title, struct_pack(a := -trust, b := src_order)) AS title
    FROM roles GROUP BY ALL)"""


@query(f"WITH {_RECORDS_SQL} SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY rank) AS at, company, title, start, 'present' AS \"end\", summary, source FROM merged")
def q_record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merge_experience(_ledger(spark, sf_dir))
    rows = merged.select("candidate_id", F.posexplode(F.arrays_zip("records", "provenance")).alias("at", "r"))
    return rows.select("candidate_id", (F.col("at") + 1).cast("long").alias("at"), "r.records.*", F.col("r.provenance.source").alias("source"))


_EDU_SQL = """studies AS (SELECT candidate_id, source_id, trust, src_order, 'Uni' || (k % 2) AS institution, 'BSc' AS degree, CASE WHEN k % 2 = 0 THEN 'Field' || (k % 3) END AS field, CASE WHEN k % 3 = 1 THEN 2000 + k % 20 END AS end_year FROM le),
  edus AS (SELECT candidate_id, lower(institution) AS i, min_by(field, struct_pack(a := -trust, b := src_order)) FILTER (WHERE field IS NOT NULL) AS field, min_by(end_year, struct_pack(a := -trust, b := src_order)) FILTER (WHERE end_year IS NOT NULL) AS end_year,
    min(struct_pack(a := -trust, b := src_order)) AS rank, min_by(institution, struct_pack(a := -trust, b := src_order)) AS institution, min_by(source_id, struct_pack(a := -trust, b := src_order)) AS source FROM studies GROUP BY ALL)"""
_LISTS_SQL = """mails AS (SELECT * FROM (SELECT candidate_id, CASE WHEN k % 2 = 0 THEN 'E' || (k % 4) ELSE 'e' || (k % 4) END AS value, source_id, trust, src_order, row_number() OVER (PARTITION BY candidate_id, k % 4 ORDER BY trust DESC, src_order) AS rn FROM le) WHERE rn = 1),
  skilled AS (SELECT candidate_id, k % 3 AS s, CASE WHEN k % 2 = 0 THEN 'SKILL' || (k % 3) ELSE 'skill' || (k % 3) END AS value, source_id, trust, src_order FROM le),
  skills AS (SELECT candidate_id, s, min_by(value, struct_pack(a := -trust, b := value)) AS name, floor(least(1, max(trust) + 0.1 * (1 - pow(0.6, count(DISTINCT source_id) - 1)) / 0.4) * 1000 + 0.5 + 1e-9) / 1000 AS confidence,
    string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, min(source_id) AS source FROM skilled GROUP BY ALL),
  skill_mean AS (SELECT candidate_id, floor(sum(confidence) / count(*) * 1000 + 0.5 + 1e-9) / 1000 AS c FROM skills GROUP BY ALL),
  parts AS (SELECT candidate_id, field_path AS f, confidence AS c FROM scalars UNION ALL SELECT DISTINCT candidate_id, 'emails', 0.9 FROM le UNION ALL SELECT candidate_id, 'skills', c FROM skill_mean UNION ALL SELECT DISTINCT candidate_id, 'experience', 0.8 FROM le UNION ALL SELECT DISTINCT candidate_id, 'education', 0.8 FROM le),
  weighted AS (SELECT candidate_id, c, CASE f WHEN 'full_name' THEN 3.0 WHEN 'emails' THEN 2.5 WHEN 'headline' THEN 1.0 WHEN 'skills' THEN 1.5 WHEN 'experience' THEN 1.5 WHEN 'education' THEN 1.0 ELSE 0.8 END AS w FROM parts),
  overall AS (SELECT candidate_id, floor(sum(w * c) / sum(w) * 1000 + 0.5 + 1e-9) / 1000 AS overall_confidence FROM weighted GROUP BY candidate_id)"""


@query(f"WITH {_WIN_SQL}, {_LISTS_SQL} SELECT * FROM overall")
def q_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonical_records(_ledger(spark, sf_dir)).select("candidate_id", "overall_confidence")


_FIELD_RANK = _sql_map({f: str(i) for i, f in enumerate(["full_name", "headline", "years_experience", "location.country"])}, "field_path")


@query(
    f"""WITH {_WIN_SQL}, {_LISTS_SQL}, {_RECORDS_SQL[len(_EVENTS_SQL) + 2 :]}, {_EDU_SQL},
  traced AS (SELECT candidate_id, 0 AS part, {_FIELD_RANK}::BIGINT AS pos, field_path AS field, source_id AS source, method FROM scalars
    UNION ALL SELECT candidate_id, 1, row_number() OVER (PARTITION BY candidate_id ORDER BY trust DESC, src_order), 'emails', source_id, 'm:email' FROM mails
    UNION ALL SELECT candidate_id, 2, s, 'skills:' || name, source, 'm:skill' FROM skills
    UNION ALL SELECT candidate_id, 3, row_number() OVER (PARTITION BY candidate_id ORDER BY rank), 'experience', source, 'm:role' FROM merged
    UNION ALL SELECT candidate_id, 4, row_number() OVER (PARTITION BY candidate_id ORDER BY rank), 'education', source, 'm:study' FROM edus)
  SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY part, pos) AS at, field, source, method FROM traced"""
)
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.canonical_records(_ledger(spark, sf_dir)).select("candidate_id", F.posexplode("provenance").alias("at", "p"))
    return rows.select("candidate_id", (F.col("at") + 1).cast("long").alias("at"), "p.*")


@query(f"WITH {_EVENTS_SQL}, n AS (SELECT candidate_id, source_id, 8 * count(*) AS claims FROM le GROUP BY ALL) SELECT candidate_id, source_id, claims::BIGINT AS claims, (sum(claims) OVER (PARTITION BY candidate_id))::BIGINT AS ledger_size FROM n")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_source = _ledger(spark, sf_dir).groupBy("candidate_id", "source_id").agg(F.count("*").alias("claims"))
    sizes = per_source.groupBy("candidate_id").agg(F.sum("claims").alias("ledger_size"))
    return per_source.join(sizes, "candidate_id")


_CANONICAL_SQL = f"""{_WIN_SQL}, {_LISTS_SQL}, {_RECORDS_SQL[len(_EVENTS_SQL) + 2 :]}, {_EDU_SQL},
  wide AS (SELECT candidate_id, max(CASE WHEN field_path = 'full_name' THEN value END) AS full_name, max(CASE WHEN field_path = 'headline' THEN value END) AS headline, max(CASE WHEN field_path = 'years_experience' THEN num END) AS years_experience,
    max(CASE WHEN field_path = 'location.country' THEN value END) AS country FROM scalars GROUP BY candidate_id),
  e AS (SELECT candidate_id, string_agg(value, '|' ORDER BY trust DESC, src_order) AS emails, list(value ORDER BY trust DESC, src_order) AS email_list FROM mails GROUP BY ALL),
  s AS (SELECT candidate_id, string_agg(name || ':' || sources, '|' ORDER BY s) AS skills, string_agg(name, '|' ORDER BY s) AS skill_names FROM skills GROUP BY ALL),
  x AS (SELECT candidate_id, string_agg(company || '/' || title || '/' || coalesce(start, '-') || '/' || coalesce(summary, '-'), '|' ORDER BY rank) AS experience FROM merged GROUP BY ALL),
  d AS (SELECT candidate_id, string_agg(institution || '/' || coalesce(field, '-') || '/' || coalesce(end_year::VARCHAR, '-'), '|' ORDER BY rank) AS education FROM edus GROUP BY ALL),
  canonical AS (SELECT * FROM wide JOIN e USING (candidate_id) JOIN s USING (candidate_id) JOIN x USING (candidate_id) JOIN d USING (candidate_id) JOIN overall USING (candidate_id))"""


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, full_name, headline, years_experience, country, emails, skills, experience, education, overall_confidence FROM canonical")
def q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c, f: F.array_join(F.transform(c, f), "|").alias(c)
    dash = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return C.canonical_records(_ledger(spark, sf_dir)).select(
        "candidate_id",
        "full_name",
        "headline",
        "years_experience",
        F.col("location.country").alias("country"),
        F.array_join("emails", "|").alias("emails"),
        joined("skills", lambda s: F.concat(s["name"], F.lit(":"), F.array_join(s["sources"], ","))),
        joined("experience", lambda r: F.concat_ws("/", r["company"], r["title"], dash(r["start"]), dash(r["summary"]))),
        joined("education", lambda r: F.concat_ws("/", r["institution"], dash(r["field"]), dash(r["end_year"]))),
        "overall_confidence",
    )


@query(f"WITH {_WIN_SQL} SELECT candidate_id, field_path, confidence FROM scalars")
def q_field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonical_records(_ledger(spark, sf_dir)).select("candidate_id", F.explode("field_confidence").alias("field_path", "confidence"))


# ---- projection and validation ----


def _projected(spark: SparkSession, sf_dir: str, fields: list[dict], **more) -> DataFrame:
    config = {"fields": [{"path": "candidate_id"}, *fields], "include_confidence": False} | more
    return project(C.canonical_records(_ledger(spark, sf_dir)), config)


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, full_name, headline, overall_confidence FROM canonical")
def q_project_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, [{"path": "full_name", "type": "string"}, {"path": "headline"}], include_confidence=True).drop("projection_error")


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, full_name AS label, country AS nation FROM canonical")
def q_project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, [{"path": "label", "from": "full_name"}, {"path": "nation", "from": "location.country"}]).drop("projection_error")


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, email_list[1] AS first_email, email_list[3] AS third_email, NULL::VARCHAR AS never FROM canonical")
def q_project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, [{"path": "first_email", "from": "emails[0]"}, {"path": "third_email", "from": "emails[2]"}, {"path": "never", "from": "emails.x[1]"}]).drop("projection_error")


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, skill_names FROM canonical")
def q_project_pluck(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _projected(spark, sf_dir, [{"path": "names", "from": "skills[].name", "type": "string[]"}])
    return out.select("candidate_id", F.array_join("names", "|").alias("skill_names"))


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, country AS place_country, email_list[1] AS place_mail FROM canonical")
def q_project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _projected(spark, sf_dir, [{"path": "place.country", "from": "location.country"}, {"path": "place.contact.mail", "from": "emails[0]"}])
    return out.select("candidate_id", F.col("place.country").alias("place_country"), F.col("place.contact.mail").alias("place_mail"))


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, headline, NULL::VARCHAR AS portfolio FROM canonical")
def q_project_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, [{"path": "headline"}, {"path": "portfolio", "from": "links.portfolio", "required": True}], on_missing="null").drop("projection_error")


@query(f"""WITH {_CANONICAL_SQL} SELECT candidate_id, '{{"who":"' || full_name || '"' || coalesce(',"headline":"' || headline || '"', '') || ',"years":' || (years_experience::BIGINT) || '}}' AS output FROM canonical""")
def q_project_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"fields": [{"path": "who", "from": "full_name"}, {"path": "headline"}, {"path": "deep.portfolio", "from": "links.portfolio"}, {"path": "years", "from": "years_experience"}], "on_missing": "omit", "include_confidence": False}
    return project_json(C.canonical_records(_ledger(spark, sf_dir)), config, keep=("candidate_id",)).select("candidate_id", "output")


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, list_aggregate(list_transform(email_list, lambda x: '[' || x || ']'), 'string_agg', '') AS names, NULL::VARCHAR AS mail FROM canonical")
def q_project_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _projected(spark, sf_dir, [{"path": "names", "from": "emails", "normalize": "name", "type": "string[]"}, {"path": "mail", "from": "emails[0]", "normalize": "email"}])
    return out.select("candidate_id", F.array_join(F.transform("names", lambda x: F.concat(F.lit("["), x, F.lit("]"))), "").alias("names"), "mail")


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, years_experience::BIGINT::VARCHAR || '.0' AS years, candidate_id::DOUBLE AS number FROM canonical")
def q_project_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, [{"path": "years", "from": "years_experience", "type": "string"}, {"path": "number", "from": "candidate_id", "type": "number"}]).drop("projection_error")


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, CASE WHEN headline IS NULL THEN 'required field ''head'' missing (from ''headline'')' END AS error FROM canonical")
def q_project_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _projected(spark, sf_dir, [{"path": "head", "from": "headline", "required": True}], on_missing="error")
    return out.select("candidate_id", F.col("projection_error").alias("error"))


@query(f"WITH {_CANONICAL_SQL} SELECT candidate_id, 'field ''full_name'' = \"' || full_name || '\" is not of type ''number''' AS error FROM canonical")
def q_type_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _projected(spark, sf_dir, [{"path": "emails", "type": "string[]"}, {"path": "full_name", "type": "number"}, {"path": "location", "type": "string"}])
    return out.select("candidate_id", F.col("projection_error").alias("error"))


@query("""SELECT c_custkey::VARCHAR AS candidate_id, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'emails must be string[]' END, CASE WHEN c_custkey % 3 = 0 THEN 'location must be an object' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'each skill must be an object with a name' END, CASE WHEN c_custkey % 7 = 0 THEN 'overall_confidence must be a number in [0,1]' END) AS errors FROM customer""")
def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    empty = lambda kind: F.array().cast(kind)
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("candidate_id"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit(None))).otherwise(F.array(F.lit("a"))).alias("emails"),
        empty("array<string>").alias("phones"),
        F.when(k % 3 != 0, F.struct(F.lit("x").alias("city"))).alias("location"),
        F.struct(empty("array<string>").alias("other")).alias("links"),
        F.when(k % 5 == 0, F.array(F.lit(None).cast("struct<name:string>"))).otherwise(F.array(F.struct(F.lit("n").alias("name")))).alias("skills"),
        empty("array<struct<a:string>>").alias("experience"),
        empty("array<struct<a:string>>").alias("education"),
        F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("overall_confidence"),
    )
    return C.validate(rows).select("candidate_id", F.array_join("validation_errors", "; ").alias("errors"))


# ---- types, dates, flags, lenient JSON ----


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
  SELECT k::VARCHAR AS candidate_id, concat_ws('; ', CASE WHEN k % 2 = 0 THEN 'candidate_id must be a string' END, CASE WHEN k % 3 = 0 THEN 'phones must be string[]' END, CASE WHEN k % 5 = 0 THEN 'links must be an object' END,
    CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'links.other must be string[]' END, CASE WHEN k % 4 = 0 THEN 'experience must be an array' END, CASE WHEN k % 4 = 1 THEN 'each experience entry must be an object' END,
    CASE WHEN k % 6 = 0 THEN 'education must be an array' END, CASE WHEN k % 6 = 1 THEN 'each education entry must be an object' END) AS errors FROM c""")
def q_validate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = F.struct(F.lit("x").alias("a"))
    listed = lambda n: F.when(k % n == 0, None).when(k % n == 1, F.array(entry, F.lit(None))).otherwise(F.array(entry))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("key"),
        F.when(k % 2 != 0, k.cast("string")).alias("candidate_id"),
        F.lit(None).cast("string").alias("full_name"),
        none.alias("emails"),
        F.when(k % 3 != 0, none).alias("phones"),
        F.struct(F.lit("x").alias("city")).alias("location"),
        F.when(k % 5 != 0, F.struct(F.lit("x").alias("github"), F.when(k % 7 != 0, none).alias("other"))).alias("links"),
        F.array().cast("array<struct<name:string>>").alias("skills"),
        listed(4).alias("experience"),
        listed(6).alias("education"),
        F.lit(None).cast("double").alias("overall_confidence"),
    )
    return C.validate(rows).select(F.col("key").alias("candidate_id"), F.array_join("validation_errors", "; ").alias("errors"))


@query("""SELECT c_custkey::VARCHAR AS candidate_id, concat_ws('; ', 'candidate_id must be a string', 'full_name must be string|null', CASE WHEN c_custkey % 2 = 0 THEN 'headline must be string|null' END, 'emails must be string[]',
  'phones must be string[]', 'years_experience must be number|null', 'location.city must be string|null', CASE WHEN c_custkey % 3 = 0 THEN 'links.portfolio must be string|null' END, 'links.other must be string[]',
  'each skill must be an object with a name', 'experience must be an array', 'each education entry must be an object', 'overall_confidence must be a number in [0,1]') AS errors FROM customer""")
def q_validate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("candidate_id"),
        F.lit(True).alias("full_name"),
        F.when(k % 2 == 0, k).alias("headline"),
        F.array(k).alias("emails"),
        F.lit("x").alias("phones"),
        F.lit("9").alias("years_experience"),
        F.struct(k.alias("city"), F.lit("x").alias("region")).alias("location"),
        F.struct(F.lit("x").alias("linkedin"), F.when(k % 3 == 0, k).alias("portfolio"), F.lit("x").alias("other")).alias("links"),
        F.array(F.lit("python")).alias("skills"),
        F.lit("x").alias("experience"),
        F.array(k).alias("education"),
        F.lit("0.5").alias("overall_confidence"),
    )
    return C.validate(rows).select(F.col("candidate_id").cast("string").alias("candidate_id"), F.array_join("validation_errors", "; ").alias("errors"))


_PREFIX_SQL = "left(strftime(ts, '%Y-%m-%d'), ([4, 7, 10, 0])[1 + event_id % 4])"


@query(
    f"""WITH c AS (SELECT user_id::VARCHAR AS candidate_id, event_id, event_type, 'v' || event_id AS value, {_PREFIX_SQL} AS observed_at FROM events)
  SELECT candidate_id, value, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY translate(observed_at, '9876543210-', 'abcdefghijk'), event_id) AS rn FROM c) WHERE rn = 1"""
)
def q_recency_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of every precision: later ones first, and a shorter date before those that it begins."""
    e = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    seen = F.when(e % 4 == 0, F.substring(day, 1, 4)).when(e % 4 == 1, F.substring(day, 1, 7)).when(e % 4 == 2, day).otherwise("")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("candidate_id"), F.lit("headline").alias("field_path"), F.concat(F.lit("v"), e.cast("string")).alias("value_str"), F.lit(None).cast("double").alias("value_num"),
        F.col("event_type").alias("source_id"), F.lit("m").alias("method"), F.lit(0.5).alias("trust"), seen.alias("observed_at"), e.alias("src_order"), F.lit(0).alias("claim_seq"),
    )
    won = M.resolve_scalars(rows).select("candidate_id", F.col("value_str").alias("value"))
    dates = rows.select(F.col("value_str").alias("value"), "observed_at")
    return won.join(dates, "value").select("candidate_id", "value", "observed_at")


@query("""SELECT c_custkey::VARCHAR AS candidate_id, CASE WHEN c_custkey % 3 = 0 THEN '1970-01-01' WHEN c_custkey % 3 = 1 THEN '2026-0' || (1 + c_custkey % 9) ELSE '' END AS observed_at,
  CASE WHEN c_custkey % 4 = 0 THEN c_acctbal ELSE 0.4 END::DOUBLE AS trust, c_custkey::INTEGER % 2 AS src_order FROM customer""")
def q_observed_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and trust that a source's entry gives, or their defaults; a source that can't be used before it doesn't count."""
    k = F.col("c_custkey")
    stamp = F.when(k % 3 == 1, F.concat(F.lit("2026-0"), (1 + k % 9).cast("string"))).when(k % 3 == 2, "")
    customers = table(spark, sf_dir, "customer")
    entry = lambda pos, kind, given, trust, content: customers.select(k.cast("string").alias("candidate_id"), F.lit(pos).alias("pos"), F.lit(kind).alias("type"), F.lit("p").alias("path"), given.cast("string").alias("timestamp"), trust.cast("double").alias("trust"), content.alias("content"))
    first = entry(0, "recruiter_notes", F.lit("2020"), F.lit(None), F.when(k % 2 == 1, "nothing"))
    second = entry(1, "recruiter_notes", stamp, F.when(k % 4 == 0, F.col("c_acctbal")), F.lit("mail me: a@b.org"))
    return build_ledger(extract(first.unionByName(second), registry("recruiter_notes"))).select("candidate_id", "observed_at", "trust", "src_order")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN 7.0 END::DOUBLE AS trust FROM events""")
def q_number_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only JSON numbers are numbers: texts, booleans, lists and null aren't."""
    e, quoted = F.col("event_id"), F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))
    value = F.when(e % 6 == 0, F.col("value").cast("string")).when(e % 6 == 1, "7").when(e % 6 == 2, quoted).when(e % 6 == 3, "true").when(e % 6 == 4, "[1]").otherwise("null")
    rows = table(spark, sf_dir, "events").select("event_id", P.parse_json(F.concat(F.lit('{"trust":'), value, F.lit("}"))).alias("doc"))
    return rows.select("event_id", P.number_only(P.child(F.col("doc"), "trust")).alias("trust"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ' "it''s"' WHEN 1 THEN event_type WHEN 2 THEN (props->>'$.k') || '.0' WHEN 3 THEN 'a' || chr(10) || 'b' END AS said,
  event_id % 5 <> 4 AS ok FROM events""")
def q_json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single quotes, bare names and words, other marks, comments and line breaks in texts are read; broken documents aren't."""
    e, kind = F.col("event_id"), F.col("event_type")
    text = (
        F.when(e % 5 == 0, F.concat(F.lit("{'said': '"), kind, F.lit(" \"it\\'s\"', more: [1, TRUE]}")))
        .when(e % 5 == 1, F.concat(F.lit("# a comment\n{said = "), kind, F.lit("; other: x} // end")))
        .when(e % 5 == 2, F.concat(F.lit("{said: "), F.get_json_object("props", "$.k"), F.lit(", 'n': NaN}")))
        .when(e % 5 == 3, F.lit('{"said": "a\nb"}'))
        .otherwise(F.concat(F.lit('{ "said": "'), kind, F.lit('  "other": [ ,,, broken')))
    )
    rows = table(spark, sf_dir, "events").select("event_id", P.parse_json(text).alias("doc"))
    return rows.select("event_id", P.as_text(P.child(F.col("doc"), "said")).alias("said"), F.col("doc").isNotNull().alias("ok"))


@query("""SELECT o_orderkey, '{' || chr(10) || '  "key": ' || o_orderkey || ',' || chr(10) || '  "place": {' || chr(10) || '    "status": "' || o_orderstatus || '",' || chr(10) || '    "none": null' || chr(10) || '  },' || chr(10) ||
  '  "list": [' || chr(10) || '    "' || o_orderpriority || '",' || chr(10) || '    "x"' || chr(10) || '  ],' || chr(10) || '  "empty": []' || chr(10) || '}' AS json FROM orders""")
def q_json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct(
        F.col("o_orderkey").alias("key"),
        F.struct(F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("none")).alias("place"),
        F.array("o_orderpriority", F.lit("x")).alias("list"),
        F.array().cast("array<string>").alias("empty"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return rows.select("o_orderkey", json_text(F.col("body"), rows.schema["body"].dataType, 0).alias("json"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey < 10000000 THEN '+1' || (4000000000 + c_custkey) END AS phone, CASE WHEN n_name = 'UNITED STATES' THEN 'US' WHEN n_name = 'UNITED KINGDOM' THEN 'GB' ELSE """ + _COUNTRY_SQL("n_name") + """ END AS country,
  'u' || c_custkey || '@x.org' AS email, CASE WHEN c_custkey % 2 = 0 THEN 'Kubernetes' ELSE c_mktsegment END AS skill, '2017-06' AS since, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_normalizer_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normalizer of the registry by name, as a SQL function."""
    N.register_sql(spark)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    return rows.selectExpr(
        "c_custkey", "norm_e164('(' || substr(cast(4000000000 + c_custkey as string), 1, 3) || ') ' || substr(cast(4000000000 + c_custkey as string), 4)) AS phone", "norm_country(n_name) AS country",
        "norm_email(' U' || c_custkey || '@X.org ') AS email", "norm_canonical(CASE WHEN c_custkey % 2 = 0 THEN 'k8s' ELSE c_mktsegment END) AS skill", "norm_date('Jun 2017') AS since", "norm_name(norm_text('  ' || c_name || ' ')) AS name",
    )


@query(f"""WITH {_CANONICAL_SQL}, f AS (SELECT unnest(['both', 'neither', 'default', 'not a boolean']) AS flags)
  SELECT candidate_id, flags, CASE WHEN flags <> 'neither' THEN overall_confidence END AS overall_confidence, CASE WHEN flags = 'both' THEN 'full_name' END AS first_traced FROM canonical, f""")
def q_include_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a configuration's flags include: confidence unless it is false, provenance if it is true."""
    records = C.canonical_records(_ledger(spark, sf_dir))
    configs = {
        "both": {"include_confidence": True, "include_provenance": True},
        "neither": {"include_confidence": False, "include_provenance": False},
        "default": {},
        "not a boolean": {"include_confidence": "no", "include_provenance": "yes"},
    }
    out = None
    for name, flags in configs.items():
        text = project_json(records, {"fields": [{"path": "candidate_id"}]} | flags, keep=("candidate_id",))
        part = text.select("candidate_id", F.lit(name).alias("flags"), F.get_json_object("output", "$.overall_confidence").cast("double").alias("overall_confidence"), F.get_json_object("output", "$.provenance[0].field").alias("first_traced"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_CANONICAL_SQL} SELECT candidate_id, true AS has_name, false AS has_confidence, false AS has_provenance, 'name,sources' AS skill_keys, string_split(skill_names, '|')[1] AS first_skill FROM canonical""")
def q_pruned_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records with both flags off: no confidences anywhere, no provenance."""
    records = C.without_provenance(C.without_confidence(C.canonical_records(_ledger(spark, sf_dir))))
    text = project_json(records, None, keep=("candidate_id",)).select("candidate_id", "output")
    has = lambda key: F.array_contains(F.json_object_keys("output"), key)
    return text.select(
        "candidate_id",
        has("full_name").alias("has_name"),
        (has("overall_confidence") | has("field_confidence")).alias("has_confidence"),
        has("provenance").alias("has_provenance"),
        F.array_join(F.json_object_keys(F.get_json_object("output", "$.skills[0]")), ",").alias("skill_keys"),
        F.get_json_object("output", "$.skills[0].name").alias("first_skill"),
    )


# ---- manifests and documents in files, made from the nation table (of fixed size) ----


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """A folder with a manifest and documents of every nation; its path and the manifests'."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:{tempfile.mkdtemp(prefix='ledgerloom-')}"
    folder = f"{root.rstrip('/')}/manifests-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    manifests = []
    for key, name in sorted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()):
        entries = [
            {"type": "github_api", "path": f"profile_{key}.json", "timestamp": "2026-06-22", "trust": 0.25},
            {"type": "recruiter_notes", "path": f"./notes_{key}.txt", "trust": "high"},
            {"type": "resume", "path": f"absent_{key}.txt", "timestamp": None},
            {"type": "ats_json", "path": f"broken_{key}.json", "timestamp": 2026},
        ]
        head = {} if key % 5 == 0 else {"candidate_id": f"c{key}"}
        files = {
            f"manifest_{key}.json": json.dumps(head | {"sources": entries}),
            f"profile_{key}.json": json.dumps({"name": name, "login": f"n{key}"}),
            f"notes_{key}.txt": f"Expertise in k8s and {name}\n",
            f"broken_{key}.json": '{"candidateName": "x',
        }
        for file, text in files.items():
            path = hadoop.Path(f"{folder}/{file}")
            out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray(text.encode()))
            out.close()
        manifests.append(f"{folder}/manifest_{key}.json")
    return folder, manifests


_FILED = ("github_api", "recruiter_notes", "resume", "ats_json")
_MANIFEST_SQL = """m AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'unknown' ELSE 'c' || n_nationkey END AS candidate_id FROM nation), e AS (
  SELECT candidate_id, k, n_name, unnest([0, 1, 2, 3]) AS pos, unnest(['github_api', 'recruiter_notes', 'resume', 'ats_json']) AS type, unnest(['profile_' || k || '.json', './notes_' || k || '.txt', 'absent_' || k || '.txt', 'broken_' || k || '.json']) AS path,
    unnest(['2026-06-22', NULL, 'null', '2026.0']) AS timestamp, unnest([0.25, NULL, NULL, NULL])::DOUBLE AS trust FROM m)"""


@query(f"WITH {_MANIFEST_SQL} SELECT candidate_id, pos, type, path, timestamp, trust FROM e")
def q_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_manifests(spark, _files(spark, sf_dir)[1]).select("candidate_id", "pos", "type", "path", "timestamp", "trust")


@query(
    f"""WITH {_MANIFEST_SQL} SELECT candidate_id, pos, type, CASE pos WHEN 0 THEN '{{"name": "' || n_name || '", "login": "n' || k || '"}}' WHEN 1 THEN 'Expertise in k8s and ' || n_name || chr(10) WHEN 3 THEN '{{"candidateName": "x' END AS content,
  CASE pos WHEN 2 THEN 'read failed: ' || path WHEN 3 THEN 'extract failed: not a JSON value' END AS error FROM e"""
)
def q_file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files found by the manifests' paths, and what became of each source."""
    folder, manifests = _files(spark, sf_dir)
    documents = read_documents(spark, read_manifests(spark, manifests), folder)
    return extract(documents, registry(*_FILED)).select("candidate_id", "pos", "type", "content", "error")


@query(
    f"""WITH {_MANIFEST_SQL}, c AS (
  SELECT candidate_id, k, 'github_api' AS source_id, unnest(['full_name', 'links.github']) AS field_path, unnest([n_name, 'https://github.com/n' || k]) AS value, unnest([0.25, 0.99])::DOUBLE AS trust, '2026-06-22' AS observed_at FROM m
  UNION ALL SELECT candidate_id, k, 'recruiter_notes', 'skills', unnest(['Kubernetes', string_split(n_name, '_')[1]]), 0.45, '1970-01-01' FROM m)
  SELECT candidate_id, source_id, field_path, value, trust, observed_at FROM c"""
)
def q_manifest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of files on disk: a trust that is no number and a date that isn't there have their defaults."""
    folder, manifests = _files(spark, sf_dir)
    ledger = build_ledger(extract(read_documents(spark, read_manifests(spark, manifests), folder), registry(*_FILED)))
    return ledger.select("candidate_id", "source_id", "field_path", F.col("value_str").alias("value"), "trust", "observed_at")


_CLI_SQL = ", ".join(
    f"('{what}', {status}, {text})"
    for what, status, text in (
        ("written", 0, "'{\n  \"who\": \"cand\",\n  \"mails\": [\n    \"a@b.org\"\n  ],\n  \"skills\": [\n    \"Go\",\n    \"Kubernetes\"\n  ]\n}\n'"),
        ("printed", 0, "'{\n  \"who\": \"cand\",\n  \"mails\": [\n    \"a@b.org\"\n  ],\n  \"skills\": [\n    \"Go\",\n    \"Kubernetes\"\n  ]\n}\n'"),
        ("explained", 0, "'  recruiter_notes  OK   3 claims\n  fax              SKIP (unknown source type ''fax'')\n  ledger: 3 claims\n  canonical schema: VALID\n'"),
        ("no manifest", 2, "''"),
        ("bad policy", 2, "''"),
        ("no arguments", 2, "''"),
    )
)


@query(f"SELECT * FROM (VALUES {_CLI_SQL}) t(what, status, text)")
def q_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's exit status, and the file, standard output or log that it writes."""
    from ledgerloom.plans import runner

    with tempfile.TemporaryDirectory(prefix="ledgerloom-") as folder:
        own = lambda name: os.path.join(folder, name)
        entries = [{"type": "recruiter_notes", "path": "notes.txt"}, {"type": "fax", "path": "notes.txt"}]
        config = {"fields": [{"path": "who", "from": "candidate_id"}, {"path": "mails", "from": "emails"}, {"path": "skills", "from": "skills[].name"}], "include_confidence": False, "on_missing": "omit"}
        for name, text in (("m.json", json.dumps({"candidate_id": "cand", "sources": entries})), ("notes.txt", "Write to a@b.org\nSkills: go, k8s"), ("c.json", json.dumps(config)), ("bad.json", '{"on_missing": "maybe"}')):
            with open(own(name), "w", encoding="utf-8") as f:
                f.write(text)
        rows = []

        def run(what: str, *arguments: str, take: str | None = None) -> None:
            out, log = io.StringIO(), io.StringIO()
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(log):
                status = runner.main([*arguments], spark)
            text = {"out": out.getvalue(), "log": log.getvalue(), None: ""}[take] if take != "file" else open(own("o.json"), encoding="utf-8").read()
            rows.append((what, status, text))

        run("written", "--manifest", own("m.json"), "--config", own("c.json"), "--out", own("o.json"), take="file")
        run("printed", "--manifest", own("m.json"), "--config", own("c.json"), take="out")
        run("explained", "--manifest", own("m.json"), "--config", own("c.json"), "--explain", take="log")
        run("no manifest", "--manifest", own("none.json"))
        run("bad policy", "--manifest", own("m.json"), "--config", own("bad.json"))
        run("no arguments")
    return spark.createDataFrame(rows, "what string, status int, text string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of every scalar field beside the candidate's overall confidence."""
    ledger = _ledger(spark, sf_dir)
    return M.resolve_scalars(ledger).join(C.canonical_records(ledger).select("candidate_id", "overall_confidence"), "candidate_id")


__all__ = ["ORACLES", "QUERIES", "flagship"]
