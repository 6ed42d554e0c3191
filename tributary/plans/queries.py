"""The engine's operators over the driver's tables, with DuckDB SQL for the same rows.

The tables hold no people, so each operator works on a column of the same kind. Confidences are in basis points, so that
values compare exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dims import CALLING_CODES, OTHER_CODES, OTHER_NATIONAL, SKILL_ALIASES, lookup
from ..model import FieldMapping, ProjectionConfig
from ..operators import merge, normalize, project, resolve, validate, verify
from ..sources import Source, json_profiles, read_sources
from ..sources.notes import EMAIL, PHONE, note_values
from ..sources.notes import blocks as note_blocks
from ..sources.registry import SOURCE_BITS
from ..sources.resume import _section_lines, parse_documents, union_months
from ..streaming.clusters import ClusterState
from .pipeline import RunStats, fuse
from .storage import shared_dir, written

QUERIES, ORACLE_SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes where each row is much work: a Parquet file of few bytes may hold many.
TASK_ROWS = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """The rows in tasks of TASK_ROWS: a scan is cut by bytes alone, so a small file with many rows would be one task."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bp(x):
    return F.round(x * 10000).cast("long")


def raw_rows(records: DataFrame, source, values: list[tuple[str, int, object]]) -> DataFrame:
    """RAW_VALUES of records (record_ord) from (field, position, column) triples; null values are left out."""
    one = lambda f, pos, x: F.struct(F.lit(f).alias("field"), F.lit(pos).alias("pos"), x.cast("string").alias("raw"))
    rows = records.select("record_ord", source.alias("source"), F.explode(F.array(*(one(*v) for v in values))).alias("v")).filter("v.raw IS NOT NULL")
    return rows.select("record_ord", "source", "v.field", "v.pos", "v.raw", F.lit(None).cast(normalize.EDUCATION).alias("edu"), F.lit("table").alias("method"), F.lit(False).alias("malformed"))


def shown(rows: DataFrame, key: str) -> DataFrame:
    """RAW_VALUES as (key, field, pos, raw), without the rows that only mark a record."""
    return rows.filter("field IS NOT NULL").select(F.col("record_ord").alias(key), "field", "pos", "raw")


@query(rf"""
SELECT doc_id, lower(e) AS email, regexp_matches(lower(e), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS ok, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS e FROM documents) GROUP BY ALL""")
def norm_email_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("text").contains("@")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1))).alias("e"))
    r = t.email(F.col("e"))
    return rows.groupBy("doc_id", r["value"].alias("email"), r["ok"].alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def _phone_sql(region: str) -> str:
    """The numbering plans as SQL over clean (text) and digits; equal rules, the same table."""
    plus, full = "starts_with(clean, '+')", lambda p: f"regexp_full_match(digits, '{p}')"
    cases = []
    for code, cc, trunk, national in CALLING_CODES:
        cases.append(f"WHEN {plus} AND {full(f'{cc}(?:{national})')} THEN '+' || digits")
        if code == region:
            if trunk:
                cases.append(f"WHEN NOT {plus} AND {full(f'{trunk}(?:{national})')} THEN '+{cc}' || substr(digits, {len(trunk) + 1})")
            cases.append(f"WHEN NOT {plus} AND {full(f'(?:{national})')} THEN '+{cc}' || digits")
            cases.append(f"WHEN NOT {plus} AND {full(f'{cc}(?:{national})')} THEN '+' || digits")
    known = "|".join(sorted({cc for _, cc, _, _ in CALLING_CODES}))
    cases.append(f"WHEN {plus} AND length(digits) <= 15 AND {full(f'(?:{OTHER_CODES}){OTHER_NATIONAL}')} AND NOT {full(f'(?:{known}).*')} THEN '+' || digits")
    return f"CASE {' '.join(cases)} END"


@query(rf"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS raw FROM documents),
c AS (SELECT doc_id, trim(raw) AS clean, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM p),
e AS (SELECT doc_id, clean, {_phone_sql("IN")} AS e164 FROM c WHERE length(digits) >= 8)
SELECT doc_id, coalesce(e164, clean) AS phone, e164 IS NOT NULL AS ok, count(*) AS n FROM e GROUP BY ALL""")
def norm_phone_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\d[\d\s().\-]{7}")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({PHONE})"), F.lit(1))).alias("raw"))
    r = t.phone(F.col("raw"), "IN")
    rows = rows.filter(F.length(F.regexp_replace("raw", "[^0-9]", "")) >= 8)
    return rows.groupBy("doc_id", r["value"].alias("phone"), r["ok"].alias("ok")).agg(F.count(F.lit(1)).alias("n"))


_URL_SQL = r"lower(rtrim(regexp_replace(regexp_replace(trim(url), '^https?://', '', 'i'), '^www\.', '', 'i'), '/'))"


@query(f"SELECT page_id, {_URL_SQL} AS canonical_url FROM pages")
def norm_url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.canonical_url(F.col("url")).alias("canonical_url"))


_LINK_SQL = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' https://www.GitHub.com/U' || page_id || '/' WHEN 2 THEN 'linkedin.com/in/P' || page_id || '/details' ELSE 'page ' || page_id END"


@query(f"""
WITH l AS (SELECT page_id, {_LINK_SQL} AS url FROM pages)
SELECT page_id, {_URL_SQL} AS canonical_url,
  CASE page_id % 4 WHEN 0 THEN 'portfolio' WHEN 1 THEN 'github' WHEN 2 THEN 'linkedin' ELSE 'unknown' END AS kind,
  CASE page_id % 4 WHEN 1 THEN 'u' || page_id WHEN 2 THEN 'p' || page_id END AS handle, page_id % 4 <> 3 AS ok FROM l""")
def url_host_kind_handle(spark, sf_dir):
    r = t.link(F.expr(_LINK_SQL))
    v = r["value"]
    return table(spark, sf_dir, "pages").select("page_id", v["url"].alias("canonical_url"), v["kind"].alias("kind"), v["handle"].alias("handle"), r["ok"].alias("ok"))


_ALIASES = ", ".join("('" + k + "', '" + v + "')" for k, v in SKILL_ALIASES.items())


@query(f"""
WITH a(k, v) AS (VALUES {_ALIASES}), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT coalesce(a.v, word) AS skill, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM w LEFT JOIN a ON a.k = lower(word)
WHERE word <> '' GROUP BY 1""")
def alias_canonicalize(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).filter("word <> ''")
    return w.groupBy(lookup(SKILL_ALIASES, F.lower("word"), F.col("word")).alias("skill")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("parts"))


#: A spelling of a country for each nation of the tables, and its code by ISO 3166.
_SPELLINGS = (
    ("Algeria", "DZ"), ("argentina", "AR"), ("BRAZIL", "BR"), ("Canada", "CA"), ("Egypt", "EG"), ("ETH", "ET"), ("France", "FR"), ("Deutschland", "DE"), ("IN", "IN"),
    ("Indonesia", "ID"), ("ir", "IR"), ("Iraq", "IQ"), ("Japan", "JP"), ("Jordan", "JO"), ("Kenya", "KE"), ("Morocco", "MA"), ("Côte d’Ivoire", "CI"), ("PE", "PE"),
    ("CHN", "CN"), ("Hungary", "HU"), ("Saudi Arabia", "SA"), ("Viet Nam", "VN"), ("Russian Federation", "RU"), ("Atlantis", None), ("U.S.A.", "US"),
)
_NATIONS_SQL = ", ".join(f"({i}, '{n}', {repr(c) if c else 'NULL'})" for i, (n, c) in enumerate(_SPELLINGS))


@query(f"""
WITH s(k, name, code) AS (VALUES {_NATIONS_SQL})
SELECT c_custkey, coalesce(code, name) AS country, code IS NOT NULL AS ok FROM customer JOIN s ON c_nationkey % 25 = k""")
def country_dim_lookup(spark, sf_dir):
    name = F.get(F.array(*(F.lit(n) for n, _ in _SPELLINGS)), F.col("c_nationkey") % 25)
    r = t.country_result(F.concat(F.lit(" "), name))
    return table(spark, sf_dir, "customer").select("c_custkey", r["value"].alias("country"), r["ok"].alias("ok"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month, o_orderkey % 5 <> 4 OR o_orderkey % 2 = 0 AS ok FROM orders""")
def norm_month(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, " yyyy-MM-dd ")).when(k == 1, F.upper(F.date_format(d, "MMM yyyy"))).when(k == 2, F.date_format(d, "MM/yyyy")).when(k == 3, F.date_format(d, "MMMM yyyy")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, "Present").otherwise("soon"))
    r = t.month(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", r["value"].alias("month"), r["ok"].alias("ok"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL WHEN 1 THEN p_size + 0.5 ELSE p_size END::DOUBLE AS years, CASE WHEN p_partkey % 3 = 2 THEN 'many' END AS text, p_partkey % 3 <> 2 AS ok FROM part""")
def norm_years(spark, sf_dir):
    size = F.col("p_size").cast("string")
    r = t.years(F.when(F.col("p_partkey") % 3 == 2, "many").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("about "), size, F.lit(".5+ years"))).otherwise(size))
    return table(spark, sf_dir, "part").select("p_partkey", r["value"]["num"].alias("years"), r["value"]["text"].alias("text"), r["ok"].alias("ok"))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier)
SELECT k AS s_suppkey, CASE k % 5 WHEN 0 THEN 'Bengaluru' WHEN 1 THEN n WHEN 2 THEN NULL WHEN 3 THEN 'Mumbai' ELSE n END AS city, CASE WHEN k % 5 = 1 THEN 'Bavaria' END AS region,
  CASE k % 5 WHEN 0 THEN 'IN' WHEN 1 THEN 'DE' WHEN 2 THEN 'PT' WHEN 4 THEN NULL END AS country FROM s""")
def norm_location(spark, sf_dir):
    k, n = F.col("s_suppkey") % 5, F.col("s_name")
    raw = F.when(k == 0, "bangalore ,  india").when(k == 1, F.concat(n, F.lit(", Bavaria, Germany"))).when(k == 2, "Portugal").when(k == 3, " BOMBAY").otherwise(n)
    v = t.location(raw)["value"]
    return table(spark, sf_dir, "supplier").select("s_suppkey", v["city"].alias("city"), v["region"].alias("region"), v["country"].alias("country"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'full_name' AS field, 0 AS pos, 'User ' || user_id AS raw FROM e UNION ALL SELECT event_id, 'emails', 0, 'u' || user_id || '@x.org' FROM e
UNION ALL SELECT event_id, 'skills', 0, 'k' || k FROM e UNION ALL SELECT event_id, 'skills', 1, event_type FROM e
UNION ALL SELECT event_id, 'location', 0, CASE WHEN k % 2 = 0 THEN 'City ' || k ELSE 'City ' || k || ', Peru' END FROM e
UNION ALL SELECT event_id, 'years_experience', 0, CAST(k AS VARCHAR) FROM e UNION ALL SELECT event_id, 'links', 0, 'github.com/u' || user_id FROM e""")
def json_extract_props(spark, sf_dir):
    """Events as candidates of an applicant-tracking export."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")).withColumn("k", F.get_json_object("props", "$.k"))
    text = F.format_string(
        '{"fullName": " User %s ", "email": "u%s@x.org", "phone": " ", "skills": ["k%s", " ", "%s"], "yearsExperience": %s, "location": {"city": "City %s", "region": null, "country": "%s"}, "links": {"a": "github.com/u%s", "b": ""}}',
        "user_id", "user_id", "k", "event_type", "k", "k", F.when(F.col("k") % 2 == 0, "").otherwise("Peru"), "user_id",
    )
    return shown(json_profiles.ats_values(e.select(F.col("event_id").alias("record_ord"), text.alias("obj"))), "event_id")


@query("""
SELECT c_custkey, 'links' AS field, 0 AS pos, 'https://github.com/c' || c_custkey AS raw FROM customer UNION ALL SELECT c_custkey, 'links', 1, 'blog.example.com' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'full_name', 0, c_name FROM customer UNION ALL SELECT c_custkey, 'skills', 0, 'Go' FROM customer UNION ALL SELECT c_custkey, 'skills', 1, c_mktsegment FROM customer""")
def github_profile_fields(spark, sf_dir):
    text = F.format_string('{"login": "c%s", "name": "%s", "blog": "%s", "email": null, "top_languages": ["Go", "Go"], "pinned_repos": [{"language": "%s"}, {"name": "x"}, {"language": "Go"}]}', "c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, "blog.example.com").otherwise(" "), "c_mktsegment")
    return shown(json_profiles.profile_values(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_ord"), text.alias("obj"))), "c_custkey")


@query("""
WITH c AS (SELECT *, c_custkey % 7 + 1 AS y FROM customer)
SELECT c_custkey, 'full_name' AS field, 0 AS pos, 'Ada Lovelace' AS raw FROM c UNION ALL SELECT c_custkey, 'headline', 0, 'Data Engineer' FROM c
UNION ALL SELECT c_custkey, 'location', 0, 'Lima, Peru' FROM c UNION ALL SELECT c_custkey, 'emails', 0, 'c' || c_custkey || '@x.org' FROM c
UNION ALL SELECT c_custkey, 'links', 0, 'github.com/c' || c_custkey FROM c UNION ALL SELECT c_custkey, 'skills', 0, 'Python' FROM c UNION ALL SELECT c_custkey, 'skills', 1, c_mktsegment FROM c
UNION ALL SELECT c_custkey, 'years_experience', 0, CASE WHEN y = 1 THEN '1' ELSE CAST(y AS VARCHAR) END FROM c
UNION ALL SELECT c_custkey, 'education', 0, 'B.Sc. Physics|UNI ' || c_custkey || '|2001-09|2005-06' FROM c""")
def resume_fields(spark, sf_dir):
    """A resume for each customer, whose jobs overlap and cover as many years as its key gives."""
    y = (F.col("c_custkey") % 7 + 1).cast("int")
    text = F.concat(
        F.lit("Ada Lovelace\nData Engineer\nLima, Peru\n"), F.concat(F.lit("c"), "c_custkey", F.lit("@x.org | github.com/c"), "c_custkey", F.lit("\n")),
        F.concat(F.lit("Skills: Python, "), "c_mktsegment", F.lit("\nExperience\nAcme  Jan 2010 - Dec "), (y + 2009).cast("string"), F.lit("\nSide job  Mar 2010 - Jun 2010\n")),
        F.concat(F.lit("Education\nB.Sc. Physics, UNI "), "c_custkey", F.lit(" (Sep 2001 to Jun 2005)\n")),
    )
    rows = parse_documents(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select(F.col("c_custkey").alias("record_ord"), text.alias("text")))
    edu = F.concat_ws("|", "edu.degree", "edu.institution", "edu.start", "edu.end")
    return shown(rows.withColumn("raw", F.when(F.col("field") == "education", edu).otherwise(F.col("raw"))), "c_custkey")


@query("""
SELECT s_suppkey, 'full_name' AS field, 0 AS pos, s_name AS raw FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'skills', 0, 'Rust' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'skills', 1, 'SQL' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'links', 0, 'github.com/s' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'full_name', 0, 'Grace Hopper' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'headline', 0, 'backend engineer' FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_suppkey, 'emails', 0, 's' || s_suppkey || '@x.org' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'skills', 0, 'Kafka' FROM supplier WHERE s_suppkey % 2 = 1""")
def note_fields(spark, sf_dir):
    """A note for each supplier: labelled lines, or prose."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    labelled = F.array(F.concat(F.lit("Name: "), "s_name"), F.lit("Skills: Rust; SQL ,"), F.concat(F.lit("GitHub: @s"), k.cast("string")), F.lit("Mood: fine"))
    prose = F.array(F.concat(F.lit("Spoke with Grace Hopper, s"), k.cast("string"), F.lit("@x.org, backend engineer, Kafka")))
    return shown(note_values(s.select(k.alias("record_ord"), F.when(k % 2 == 0, labelled).otherwise(prose).alias("lines"))), "s_suppkey")


@query("SELECT c_custkey, left(sha256('name:' || trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '-') || '|loc:'), 16) AS entity_id FROM customer")
def stable_entity_id(spark, sf_dir):
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", t.candidate_id(null, null, F.col("c_name"), null).alias("entity_id"))


# fusion of events: the user is the cluster, the event type the source, and its value the scalar
_SOURCE = {"click": "Resume", "view": "ATS", "purchase": "CSV", "signup": "GitHub"}
_PRIORITY_SQL = "CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 85 WHEN 'purchase' THEN 80 WHEN 'signup' THEN 70 ELSE 50 END"
_BASE_SQL = "CASE event_type WHEN 'click' THEN 9000 WHEN 'view' THEN 8500 WHEN 'purchase' THEN 8000 WHEN 'signup' THEN 7000 ELSE 5000 END"


def event_values(spark, sf_dir, field: str) -> tuple[DataFrame, DataFrame]:
    """Normalized values of one field and clusters: a user's events as records with a headline (the rounded value) or a skill (props.k)."""
    e = table(spark, sf_dir, "events")
    x = F.concat(F.lit("v"), F.floor(F.col("value")).cast("long").cast("string")) if field == "headline" else F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    raw = raw_rows(e.withColumn("record_ord", F.col("event_id")), lookup(_SOURCE, F.col("event_type"), F.lit("Other")), [(field, 0, x)])
    return normalize.normalize(raw, fields=(field,)), e.select(F.col("event_id").alias("record_ord"), F.col("user_id").alias("cluster_id"))


_EVENT_CTE = f"""
WITH v AS (SELECT event_id, user_id, {_PRIORITY_SQL} AS pr, {_BASE_SQL} AS base, 'v' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS x FROM events WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pr DESC, length(x) DESC, x, event_id) AS rn FROM v),
w AS (SELECT * FROM r WHERE rn = 1)"""


@query(f"""{_EVENT_CTE}
SELECT w.user_id, w.x AS winner, w.event_id, greatest(0, least(10000, w.base
  + CASE WHEN bool_or(v.x = w.x AND v.event_id <> w.event_id) THEN 500 ELSE 0 END - CASE WHEN bool_or(v.x <> w.x) THEN 1000 ELSE 0 END)) AS confidence_bp
FROM w JOIN v USING (user_id) GROUP BY w.user_id, w.x, w.event_id, w.base""")
def scalar_fusion_winner(spark, sf_dir):
    got = merge.tracked(*event_values(spark, sf_dir, "headline"))
    return got.select(F.col("cluster_id").alias("user_id"), F.col("v_str").alias("winner"), F.col("record_ord").alias("event_id"), bp(F.col("confidence")).alias("confidence_bp"))


@query(f"""{_EVENT_CTE}
SELECT w.user_id, v.x AS loser, CASE WHEN v.pr < w.pr THEN 'lower_source_priority' WHEN v.pr = w.pr AND length(v.x) < length(w.x) THEN 'less_complete' ELSE 'tiebreak_lost' END AS reason, count(*) AS n
FROM w JOIN v USING (user_id) WHERE v.x <> w.x GROUP BY ALL""")
def scalar_fusion_conflicts(spark, sf_dir):
    got = merge.compared(*event_values(spark, sf_dir, "headline")).filter("differ > 0")
    return got.groupBy(F.col("cluster_id").alias("user_id"), F.col("tiebreak").alias("loser"), "reason").agg(F.sum("differ").alias("n"))


_SOURCE_SQL = "CASE event_type WHEN 'click' THEN 'Resume' WHEN 'view' THEN 'ATS' WHEN 'purchase' THEN 'CSV' WHEN 'signup' THEN 'GitHub' ELSE 'Other' END"
_SKILL_CTE = f"""
WITH v AS (SELECT event_id, user_id, {_PRIORITY_SQL} AS pr, {_BASE_SQL} AS base, {_SOURCE_SQL} AS source, 'k' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS skill
           FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
g AS (SELECT user_id, skill, greatest(0, least(10000, arg_min(base, struct_pack(p := -pr, e := event_id)) + CASE WHEN count(*) > 1 THEN 500 ELSE 0 END)) AS confidence_bp,
             list_aggregate(list_sort(list_distinct(list(source))), 'string_agg', ',') AS sources FROM v GROUP BY ALL)"""


@query(f"{_SKILL_CTE} SELECT user_id, skill, confidence_bp, sources FROM g")
def collection_fusion(spark, sf_dir):
    got = merge.tracked(*event_values(spark, sf_dir, "skills"))
    names = F.array_sort(F.array_distinct(F.concat(F.array("primary.source"), F.transform("agreements", lambda a: a["source"]))))
    return got.select(F.col("cluster_id").alias("user_id"), F.col("v_str").alias("skill"), bp(F.col("confidence")).alias("confidence_bp"), F.array_join(names, ",").alias("sources"))


@query(f"""{_SKILL_CTE}, u AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT user_id, sum(confidence_bp) AS total, count(*) AS n FROM g GROUP BY 1)
SELECT user_id, CAST(coalesce(n, 0) AS BIGINT) AS skills, CASE WHEN n IS NULL THEN 1500 ELSE 0 END AS penalty_bp,
  CAST(round(CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE (total::DOUBLE / 10000.0::DOUBLE) / n END * 10000) AS BIGINT) AS confidence_bp FROM u LEFT JOIN s USING (user_id)""")
def record_confidence(spark, sf_dir):
    wide = _event_canonical(spark, sf_dir)
    return wide.select(F.col("cluster_id").alias("user_id"), F.size("skills").cast("long").alias("skills"), bp(F.col("completeness_penalty")).cast("int").alias("penalty_bp"), bp(F.col("record_confidence")).alias("confidence_bp"))


@query("""
SELECT c_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS skills, CASE WHEN count(o_orderkey) = 0 THEN 1500 ELSE 0 END AS penalty_bp
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def completeness_penalty(spark, sf_dir):
    """Customers without a pending order lack the required field."""
    o, c = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), table(spark, sf_dir, "customer")
    first = 1 << 44  # customers are records of their own, without values
    clusters = c.select((F.col("c_custkey") + first).alias("record_ord"), F.col("c_custkey").alias("cluster_id")).unionByName(o.select(F.col("o_orderkey").alias("record_ord"), F.col("o_custkey").alias("cluster_id")))
    v = normalize.normalize(raw_rows(o.withColumn("record_ord", F.col("o_orderkey")), F.lit("CSV"), [("skills", 0, F.concat(F.lit("p"), "o_orderpriority"))]), fields=("skills",))
    wide = merge.canonical(merge.tracked(v, clusters), clusters)
    return wide.select(F.col("cluster_id").alias("c_custkey"), F.size("skills").cast("long").alias("skills"), bp(F.col("completeness_penalty")).cast("int").alias("penalty_bp"))


def _doc_keys(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    emails = F.when(F.col("text").contains("@"), F.array_distinct(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    # written: the keys are grouped, and joined with their groups
    return written(d.select(F.col("doc_id").alias("record_ord"), F.explode(F.concat(F.array(F.md5("text")), emails)).alias("key")), "doc-keys")


@query(rf"""
WITH RECURSIVE k AS (SELECT doc_id, md5(text) AS key FROM documents UNION SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents),
f AS (SELECT key, min(doc_id) AS a FROM k GROUP BY key HAVING count(DISTINCT doc_id) > 1),
e AS (SELECT a, doc_id AS b FROM k JOIN f USING (key) WHERE doc_id <> a),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen)
SELECT node AS doc_id, min(seen) AS root FROM r GROUP BY node""")
def exact_key_components(spark, sf_dir):
    return resolve.exact_components(_doc_keys(spark, sf_dir)).select(F.col("record_ord").alias("doc_id"), "root")


@query(None)
def surname_block_pairs(spark, sf_dir):
    """Part names as people: the last word is the surname; pairs of different names with similarity of 90 or more."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    names = names.withColumn("surname", F.coalesce(t.surname_key(F.col("name")), F.lit(""))).withColumn("root", F.col("ord"))
    return resolve.name_pairs(names, 90.0).select("surname", "name_a", "name_b")


_ORDER_LINKS_SQL = """
WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'mail' WHEN o_orderkey % 7 < 3 THEN 'phone' ELSE 'none' END AS kind FROM orders),
k AS (SELECT *, CASE WHEN kind = 'none' THEN 1 ELSE row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) END AS k FROM r)
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, k) AS cluster_id FROM k"""


def _order_people(spark, sf_dir) -> DataFrame:
    """Orders as people of two spellings of one name a customer, some with an e-mail, some with a phone: all without
    either and the first of both kinds are one person, the k-th with an e-mail and the k-th with a phone another."""
    o = spread(table(spark, sf_dir, "orders")).withColumn("record_ord", F.col("o_orderkey"))
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 2 == 0, "Jonathan Smith").otherwise("Jonathon Smith"), F.col("o_custkey").cast("string"))
    phone = F.concat(F.lit("+49301"), F.lpad(key.cast("string"), 8, "0"))
    fields = [("full_name", 0, name), ("emails", 0, F.when(key % 3 == 0, F.concat(F.lit("o"), key.cast("string"), F.lit("@mail.org")))), ("phones", 0, F.when((key % 3 != 0) & (key % 7 < 3), phone))]
    return raw_rows(o, F.lit("CSV"), fields)


@query(_ORDER_LINKS_SQL)
def guarded_name_links(spark, sf_dir):
    raw = _order_people(spark, sf_dir)
    values = written(normalize.normalize(raw, fields=("full_name", "emails", "phones")), "order-people")
    return resolve.resolve(raw, values).select(F.col("record_ord").alias("o_orderkey"), "cluster_id")


@query(_ORDER_LINKS_SQL)
def arriving_name_links(spark, sf_dir):
    """The same people in two batches, each with half of everyone's orders: the clusters are those of one run."""
    raw = _order_people(spark, sf_dir)
    state = ClusterState(f"{shared_dir(spark)}/tributary/clusters-{uuid.uuid4().hex}")
    for k in range(2):
        state.update(raw.filter(F.pmod(F.xxhash64("record_ord"), F.lit(2)) == 1 - k), k)
    return state.clusters(spark).select(F.col("record_ord").alias("o_orderkey"), "cluster_id")


@query("""
WITH i AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS lo, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS hi
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate),
m AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR lo > reached THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT o_custkey, island, max(hi) - min(lo) + 1 AS months FROM g GROUP BY ALL)
SELECT o_custkey, CAST(sum(months) AS BIGINT) AS months FROM u GROUP BY 1""")
def interval_union_months(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    rows = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate >= o_orderdate")
    spans = rows.groupBy("o_custkey").agg(F.collect_set(F.struct(month("o_orderdate").alias("lo"), month("l_shipdate").alias("hi"))).alias("spans"))
    return spans.select("o_custkey", union_months(F.col("spans")).cast("long").alias("months"))


@query("""
WITH l AS (SELECT conv_id, turn, role || ' ' || turn AS line, last_value(CASE WHEN role IN ('user', 'system') THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section, role FROM conversations)
SELECT conv_id, coalesce(string_agg(CASE WHEN section = 'user' AND role NOT IN ('user', 'system') THEN line END, ',' ORDER BY turn), '') AS lines FROM l GROUP BY 1""")
def section_carry_forward(spark, sf_dir):
    """Turns of users and systems as section headers; the lines of users' sections."""
    lines = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(" ", x["role"], x["turn"].cast("string"))).alias("lines"))
    got = _section_lines(F.col("lines"), lambda x: x.rlike("^(?:user|system)"), lambda x: x.startswith("user"))
    return lines.select("conv_id", F.array_join(got, ",").alias("lines"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
r AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND pos = 3 THEN '----' ELSE line END AS x FROM l), k AS (SELECT *, regexp_matches(x, '^[ \\t]*[-=_*~]{3,}[ \\t]*$') AS rule FROM r),
f AS (SELECT *, bool_or(rule) OVER (PARTITION BY doc_id) AS ruled FROM k), g AS (SELECT *, CASE WHEN ruled THEN rule ELSE trim(x) = '' END AS brk FROM f),
b AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM g)
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines FROM b WHERE NOT brk AND trim(x) <> '' GROUP BY ALL""")
def block_split(spark, sf_dir):
    """Documents as note files; those of even ids have a rule in place of their third line."""
    d = table(spark, sf_dir, "documents")
    ruled = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((F.col("doc_id") % 2 == 0) & (i == 2), F.lit("----")).otherwise(x)), "\n")
    return note_blocks(d.select(ruled.alias("value"), F.col("doc_id").alias("file"))).select(F.col("file").alias("doc_id"), F.col("block").cast("long").alias("block"), F.size("lines").cast("long").alias("lines"))


@query("""
WITH k AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, 'emails' AS field, 'malformed' AS code, 'warning' AS severity, 'malformed value: ' || chr(39) || 'Mail of ' || k || chr(39) AS message FROM k WHERE k % 7 = 0
UNION ALL SELECT k, 'emails', 'email_format', 'error', 'not an e-mail address: mail of ' || k FROM k WHERE k % 7 = 0
UNION ALL SELECT k, 'phones', 'malformed', 'warning', 'malformed value: ' || chr(39) || '12' || chr(39) FROM k WHERE k % 11 = 0
UNION ALL SELECT k, 'phones', 'phone_format', 'error', 'not an E.164 number: 12' FROM k WHERE k % 11 = 0
UNION ALL SELECT k, 'skills', 'malformed', 'warning', 'malformed value: ' || chr(39) || '1234' || chr(39) FROM k WHERE k % 5 = 0
UNION ALL SELECT k, 'education', 'date_format', 'error', 'not YYYY-MM: 2001' FROM k WHERE k % 13 = 0""")
def validation_issues(spark, sf_dir):
    """Customers as people whose key decides what is wrong with them; issues of the merged rows."""
    c, k = spread(table(spark, sf_dir, "customer")).withColumn("record_ord", F.col("c_custkey")), F.col("c_custkey")
    email = F.when(k % 7 == 0, F.concat(F.lit("Mail of "), k.cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org")))
    phone = F.when(k % 11 == 0, "12").otherwise(F.concat(F.lit("+1 212 55"), F.lpad((k % 100000).cast("string"), 5, "0")))
    rows = raw_rows(c, F.lit("CSV"), [("full_name", 0, F.col("c_name")), ("emails", 0, email), ("phones", 0, phone), ("skills", 0, F.when(k % 5 == 0, "1234").otherwise("Go")), ("location", 0, F.lit("Lima, Peru")), ("education", 0, F.lit("school"))])
    edu = F.struct(F.lit("UNI").alias("institution"), F.lit(None).cast("string").alias("degree"), F.lit(None).cast("string").alias("field_of_study"), F.when(F.col("record_ord") % 13 == 0, "2001").otherwise("2001-09").alias("start"), F.lit(None).cast("string").alias("end"))
    rows = rows.withColumn("edu", F.when(F.col("field") == "education", edu).cast(normalize.EDUCATION))
    clusters = c.select("record_ord", k.alias("cluster_id"))
    # written: the values meet their winners, which are found among them, so that they would be normalized twice
    values = written(normalize.normalize(rows), "customer-values")
    found = validate.issues(merge.canonical(merge.tracked(values, clusters), clusters))
    return found.select(F.col("cluster_id").alias("c_custkey"), "field", "code", "severity", "message")


@query("""
WITH l AS (SELECT page_id, page_id % 4 = 0 AS plain, 'u' || page_id % 10 AS handle FROM pages)
SELECT 'known' AS given, page_id, CASE WHEN NOT plain AND handle IN ('u3', 'u7') THEN 'github_verified' ELSE 'none' END AS code, CASE WHEN NOT plain AND handle IN ('u3', 'u7') THEN 9500 ELSE 9000 END AS confidence_bp FROM l
UNION ALL SELECT 'unknown', page_id, CASE WHEN plain THEN 'github_unverified' ELSE 'github_mismatch' END, CASE WHEN plain THEN 9000 ELSE 8000 END FROM l""")
def verify_handles(spark, sf_dir):
    """Pages as people with one link each; handles given that some of them have, and one that none has."""
    p = table(spark, sf_dir, "pages").withColumn("record_ord", F.col("page_id"))
    link = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat(F.lit("https://github.com/u"), (F.col("page_id") % 10).cast("string")))
    clusters = p.select("record_ord", F.col("page_id").alias("cluster_id"))
    canon = written(merge.canonical(merge.tracked(normalize.normalize(raw_rows(p, F.lit("Resume"), [("links", 0, link)]), fields=("links",)), clusters), clusters), "verify")
    out = []
    for given, handles in (("known", ["https://github.com/u3", "@U7"]), ("unknown", ["nobody"])):
        rows, found = verify.verify(canon, "github", handles, bonus=True)
        rows = rows.join(found.select("cluster_id", "code"), "cluster_id", "left")
        out.append(rows.select(F.lit(given).alias("given"), F.col("cluster_id").alias("page_id"), F.coalesce("code", F.lit("none")).alias("code"), bp(F.get("links", F.lit(0))["confidence"]).cast("int").alias("confidence_bp")))
    return out[0].unionByName(out[1])


def _event_canonical(spark, sf_dir) -> DataFrame:
    v, c = event_values(spark, sf_dir, "skills")
    return merge.canonical(merge.tracked(v, c), c)


def _projected(spark, sf_dir, missing: str, path: str) -> DataFrame:
    config = ProjectionConfig(fields=(FieldMapping(path, "skill"),), missing=missing)
    return project.project(_event_canonical(spark, sf_dir), config).select(F.col("cluster_id").alias("user_id"), "output")


_NTH_SQL = """WITH s AS (SELECT user_id, list_sort(list_distinct(list('k' || json_extract_string(props, '$.k')) FILTER (json_extract_string(props, '$.k') IS NOT NULL))) AS k FROM events GROUP BY 1)
SELECT user_id, {0} AS output FROM s"""


@query(_NTH_SQL.format("""CASE WHEN k[3] IS NULL THEN '{"skill": null}' ELSE '{"skill": "' || k[3] || '"}' END"""))
def project_null_policy(spark, sf_dir):
    return _projected(spark, sf_dir, "null", "skills[2]")


@query(_NTH_SQL.format("""CASE WHEN k[3] IS NULL THEN '{"skill": ""}' ELSE '{"skill": "' || k[3] || '"}' END"""))
def project_empty_policy(spark, sf_dir):
    return _projected(spark, sf_dir, "empty_string", "skills[2]")


@query(_NTH_SQL.format("""CASE WHEN k[1] IS NULL THEN '{}' ELSE '{"skill": "' || k[1] || '"}' END"""))
def project_indexed(spark, sf_dir):
    return _projected(spark, sf_dir, "omit", "skills[0]")


@query(f"""
WITH p AS (SELECT c_custkey AS id, regexp_extract(c_name, '([0-9]+)', 1) AS k, c_nationkey AS n FROM customer), s AS (SELECT regexp_extract(s_name, '([0-9]+)', 1) AS k, s_nationkey AS n FROM supplier),
b AS (SELECT p.k, p.n AS a, s.n AS b FROM p JOIN s USING (k))
SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM s) AS records_in, (SELECT count(DISTINCT k) FROM (SELECT k FROM p UNION ALL SELECT k FROM s)) AS clusters_out,
  CAST((SELECT coalesce(sum(1 + CASE WHEN a <> b THEN 1 ELSE 0 END), 0) FROM b) AS BIGINT) AS conflicts_found""")
def run_stats(spark, sf_dir):
    stats = RunStats()
    fuse(_customer_values(spark, sf_dir), stats=stats)
    return spark.createDataFrame([(stats.records_in, stats.clusters_out, stats.conflicts_found)], "records_in long, clusters_out long, conflicts_found long")


@query("""
WITH r AS (SELECT 0 AS source, c_custkey AS id, c_name AS name, c_mktsegment AS skill FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 0, 1000000000 + c_custkey, c_name, NULL FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT 1, s_suppkey, s_name, NULL FROM supplier)
SELECT row_number() OVER (ORDER BY source, id) AS place, CAST(source AS BIGINT) AS source, name, skill FROM r""")
def source_union_ordered(spark, sf_dir):
    """Two folders of delimited files, read as sources in order: of customers with two headers, and of suppliers."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    at = f"{shared_dir(spark)}/tributary/sources-{uuid.uuid4().hex}"
    parts = (("0/a", c.filter("c_custkey % 2 = 0").sort("c_custkey").selectExpr("c_name AS `Full Name`", "c_mktsegment AS skillset")), ("0/b", c.filter("c_custkey % 2 = 1").sort("c_custkey").selectExpr("'x' AS other", "c_name AS candidate")), ("1/a", s.sort("s_suppkey").selectExpr("s_name AS name")))
    for place, rows in parts:
        rows.coalesce(1).write.csv(f"{at}/{place}", header=True)
    rows = read_sources(spark, [Source("csv", f"{at}/0/*"), Source("csv", f"{at}/1/*")]).filter("field IS NOT NULL")
    people = rows.groupBy("record_ord").agg(F.max(F.when(F.col("field") == "full_name", F.col("raw"))).alias("name"), F.max(F.when(F.col("field") == "skills", F.col("raw"))).alias("skill"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("record_ord"))
    people = people.withColumn("source", F.shiftright("record_ord", SOURCE_BITS)).withColumn("place", place)
    first = people.filter("source = 0").count()
    return people.select((F.col("place") + F.when(F.col("source") == 1, F.lit(first)).otherwise(F.lit(0))).cast("long").alias("place"), "source", "name", "skill")


def _customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as people of two sources; equal numbers in their names are one person."""
    c, s, n = spread(table(spark, sf_dir, "customer")), spread(table(spark, sf_dir, "supplier")), table(spark, sf_dir, "nation")
    n = F.broadcast(n.select(F.col("n_nationkey").alias("nk"), "n_name"))
    c = c.join(n, F.col("c_nationkey") == F.col("nk"), "left").select(F.col("c_custkey").alias("record_ord"), F.lit("ATS").alias("src"), F.col("c_name").alias("name"), "n_name", F.col("c_mktsegment").alias("skill"))
    s = s.join(n, F.col("s_nationkey") == F.col("nk"), "left").select((F.col("s_suppkey") + F.lit(1 << 44)).alias("record_ord"), F.lit("CSV").alias("src"), F.col("s_name").alias("name"), "n_name", F.lit(None).cast("string").alias("skill"))
    email = F.concat(F.regexp_extract("name", r"(\d+)", 1), F.lit("@example.com"))
    return written(raw_rows(c.unionByName(s), F.col("src"), [("full_name", 0, F.col("name")), ("emails", 0, email), ("location", 0, F.col("n_name")), ("skills", 0, F.col("skill"))]), "raw-values")


@query(r"""
WITH c AS (SELECT c_custkey AS id, c_name AS name, n_name AS place, c_mktsegment AS skill, regexp_extract(c_name, '([0-9]+)', 1) AS k FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey + 17592186044416 AS id, s_name AS name, n_name AS place, regexp_extract(s_name, '([0-9]+)', 1) AS k FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT k, c.id AS c_id, s.id AS s_id, c.name AS c_name, s.name AS s_name, c.place AS c_place, s.place AS s_place, c.skill FROM c FULL JOIN s USING (k)),
x AS (SELECT *, c_id IS NOT NULL AND s_id IS NOT NULL AS two, CASE WHEN c_id IS NULL THEN 8000 ELSE 8500 END AS base FROM b),
y AS (SELECT *, base - CASE WHEN two THEN 1000 ELSE 0 END AS of_name, base + CASE WHEN two THEN 500 ELSE 0 END AS of_email, base + CASE WHEN NOT two THEN 0 WHEN c_place = s_place THEN 500 ELSE -1000 END AS of_place FROM x)
SELECT coalesce(c_id, s_id) AS cluster_id, left(sha256('email:' || k || '@example.com'), 16) AS candidate_id, coalesce(c_name, s_name) AS full_name, coalesce(c_place, s_place) AS city,
  k || '@example.com' AS emails, coalesce(skill, '') AS skills,
  CAST(round(CASE WHEN c_id IS NULL THEN (((of_name + of_email + of_place)::DOUBLE / 10000.0::DOUBLE) / 3 - 0.15::DOUBLE) ELSE ((of_name + of_email + of_place + 8500)::DOUBLE / 10000.0::DOUBLE) / 4 END * 10000) AS BIGINT) AS record_confidence_bp FROM y""")
def fuse_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: customers and suppliers through the whole engine."""
    canon, _ = fuse(_customer_values(spark, sf_dir))
    value = lambda f: F.col(f)["value"]
    joined = lambda f: F.array_join(F.transform(f, lambda e: e["value"]), ",")
    return canon.select("cluster_id", "candidate_id", value("full_name").alias("full_name"), value("location")["city"].alias("city"), joined("emails").alias("emails"), joined("skills").alias("skills"), bp(F.col("record_confidence")).alias("record_confidence_bp"))


@query("""
WITH p AS (SELECT c_custkey AS id, regexp_extract(c_name, '(\\d+)', 1) AS k, 'A' AS src FROM customer UNION ALL SELECT s_suppkey + 17592186044416, regexp_extract(s_name, '(\\d+)', 1), 'S' FROM supplier)
SELECT min(id) AS cluster_id, count(*) AS records, left(sha256('email:' || k || '@example.com'), 16) AS candidate_id FROM p GROUP BY k""".replace("\\\\", "\\"))
def fused_people(spark, sf_dir):
    return _people(spark, sf_dir)


def _people(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = c.select(F.col("c_custkey").alias("record_ord"), F.col("c_name").alias("name")).unionByName(s.select((F.col("s_suppkey") + F.lit(1 << 44)).alias("record_ord"), F.col("s_name").alias("name")))
    rows = rows.withColumn("key", F.concat(F.regexp_extract("name", r"(\d+)", 1), F.lit("@example.com")))
    roots = resolve.exact_components(rows.select("record_ord", "key"))
    of = rows.join(roots, "record_ord", "left").withColumn("root", F.coalesce("root", "record_ord"))
    null = F.lit(None).cast("string")
    return of.groupBy(F.col("root").alias("cluster_id"), t.candidate_id(F.col("key"), null, null, null).alias("candidate_id")).agg(F.count(F.lit(1)).alias("records"))
