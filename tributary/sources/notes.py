"""Recruiter notes: blocks of labelled lines, or prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import lookup
from ..functions.text import strip, words
from .registry import FILE, files_of, in_order, many, one, register, values

METHOD = "note_text"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s().\-]{7,}\d"
RULE = r"^\s*[-=_*~]{3,}\s*$"
LABELLED = r"^\s*([A-Za-z][A-Za-z /&_-]*?)\s*:\s*(.+?)\s*$"

# Labels, title words, words that are no names, words that are no skills.
LABELS = {
    "name": "full_name", "full name": "full_name", "candidate": "full_name", "email": "emails", "e-mail": "emails", "emails": "emails",
    "phone": "phones", "mobile": "phones", "phones": "phones", "tel": "phones", "title": "headline", "headline": "headline", "role": "headline",
    "position": "headline", "current title": "headline", "years": "years_experience", "yoe": "years_experience",
    "years of experience": "years_experience", "experience": "years_experience", "skills": "skills", "skillset": "skills", "tech": "skills",
    "location": "location", "based in": "location", "city": "location", "github": "links", "linkedin": "links", "links": "links",
    "url": "links", "portfolio": "links", "website": "links",
}
TITLE_WORDS = ("engineer", "developer", "scientist", "manager", "analyst", "designer", "architect", "consultant", "lead", "intern", "researcher", "specialist")
NOT_NAMES = (
    "spoke", "talked", "met", "with", "re", "note", "notes", "and", "candidate", "referral", "recommended", "via", "internal", "strong", "junior",
    "senior", "available", "contact", "phone", "email", "the", "a", "an",
)
NOT_SKILLS = (
    "available", "immediately", "now", "strong", "junior", "senior", "mid", "solid", "great", "good", "dev", "developer", "engineer", "years", "year",
    "yrs", "yr", "experience", "recommended", "referral", "backend", "frontend", "fullstack", "full-stack", "based",
)


def found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def phones_in(text: Column) -> Column:
    enough = F.filter(F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1)), lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 8)
    return F.array_distinct(F.transform(enough, lambda s_: strip(s_)))


def has_any(x: Column, choices: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, choices)), lambda w: x.contains(w))


def prose_name(text: Column) -> Column:
    """The first run of two to four capitalised words that are no fillers."""
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z.'\-]*)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("run"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        fits = t.rlike(r"^[A-Z][a-z.'\-]+$") & ~F.lower(t).isin(*NOT_NAMES)
        longer = F.struct(F.array_append(s["run"], t).alias("run"), (F.size(s["run"]) == 3).alias("done"))
        ended = F.struct(F.when(F.size(s["run"]) >= 2, s["run"]).otherwise(F.array().cast("array<string>")).alias("run"), (F.size(s["run"]) >= 2).alias("done"))
        return F.when(s["done"], s).when(fits, longer).otherwise(ended)

    return F.aggregate(tokens, start, step, lambda s: F.when(F.size(s["run"]) >= 2, F.array_join(s["run"], " ")))


def prose_headline(text: Column) -> Column:
    clauses = F.transform(F.split(text, r"[,.;()\-]"), lambda s_: strip(s_))
    return F.get(F.filter(clauses, lambda c: (c != "") & has_any(F.lower(c), (*TITLE_WORDS, "dev")) & (F.size(words(c)) <= 6)), F.lit(0))


def prose_skills(text: Column, exclude: Column) -> Column:
    tokens = F.transform(F.split(text, "[,;&/]| - | and "), lambda t: strip(t, r" .\-~"))

    def is_skill(t: Column) -> Column:
        w = words(F.lower(t))
        return (t != "") & ~t.contains("@") & ~F.array_contains(exclude, F.lower(t)) & (F.size(w) <= 2) & ~(t.rlike(r"\d") & (F.size(w) > 1)) & ~F.exists(w, lambda x: x.isin(*NOT_SKILLS))

    return F.array_distinct(F.filter(tokens, is_skill))


def blocks(text: DataFrame) -> DataFrame:
    """block number and its lines (in order) of one note file: split at rules if there are any, else at blank lines."""
    lines = text.select(F.posexplode(F.split("value", r"\R")).alias("pos", "line"), "file")
    of_file = Window.partitionBy("file")
    ruled = F.max(F.col("line").rlike(RULE)).over(of_file)
    lines = lines.withColumn("is_break", F.when(ruled, F.col("line").rlike(RULE)).otherwise(strip(F.col("line")) == ""))
    number = F.sum(F.col("is_break").cast("int")).over(of_file.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.withColumn("block", number).filter(~F.col("is_break") & (strip(F.col("line")) != ""))
    return kept.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"].alias("lines"))


def _links(key: Column, text: Column) -> Column:
    parts = F.filter(F.split(text, r"[,\s]+"), lambda p: p != "")
    bare = lambda p: F.regexp_replace(p, "^[@/]+", "")
    return F.transform(parts, lambda p: F.when((key == "github") & ~F.lower(p).contains("github.com"), F.concat(F.lit("github.com/"), bare(p))).when((key == "linkedin") & ~F.lower(p).contains("linkedin.com"), F.concat(F.lit("linkedin.com/in/"), bare(p))).otherwise(p))


@register("notes", "recruiter_notes")
def read_notes(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select("value", F.col(FILE).alias("file"))
    return note_values(in_order(blocks(text).withColumn("at", F.col("block")), files_of(text)))


def note_values(rows: DataFrame) -> DataFrame:
    """RAW_VALUES of blocks (record_ord, lines)."""
    key = lambda line: F.lower(strip(F.regexp_extract(line, LABELLED, 1)))
    pairs = F.transform(F.col("lines"), lambda line: F.struct(key(line).alias("key"), lookup(LABELS, key(line), F.lit(None).cast("string")).alias("field"), strip(F.regexp_extract(line, LABELLED, 2)).alias("text")))
    rows = rows.withColumn("pairs", F.filter(pairs, lambda p: p["field"].isNotNull())).withColumn("text", F.array_join(F.transform("lines", lambda s_: strip(s_)), " "))
    labelled, text = F.size("pairs") > 0, F.col("text")
    none = F.array().cast("array<string>")
    of = lambda f: F.filter("pairs", lambda p: p["field"] == f)
    first = lambda f: F.get(of(f), F.lit(0))["text"]
    split = lambda f: F.flatten(F.transform(of(f), lambda p: F.filter(F.transform(F.split(p["text"], "[,;]"), lambda s_: strip(s_)), lambda x: x != "")))
    emails, name = found(text, EMAIL), prose_name(text)
    exclude = F.transform(F.concat(emails, F.array_compact(F.array(name))), F.lower)
    out = values(rows, "Recruiter Note", [
        one("full_name", F.when(labelled, first("full_name")).otherwise(name), METHOD),
        one("headline", F.when(labelled, first("headline")).otherwise(prose_headline(text)), METHOD),
        one("location", F.when(labelled, first("location")), METHOD),
        one("years_experience", F.when(labelled, first("years_experience")), METHOD),
        many("emails", F.when(labelled, split("emails")).otherwise(emails), METHOD),
        many("phones", F.when(labelled, split("phones")).otherwise(phones_in(text)), METHOD),
        many("skills", F.when(labelled, split("skills")).otherwise(prose_skills(text, exclude)), METHOD),
        many("links", F.when(labelled, F.flatten(F.transform(of("links"), lambda p: _links(p["key"], p["text"])))).otherwise(none), METHOD),
    ])
    # a labelled block exists even if its lists come out empty; prose without any value does not
    some = out.filter("field IS NOT NULL").select("record_ord").union(rows.filter(labelled).select("record_ord")).distinct()
    return out.join(some, "record_ord", "left_semi")
