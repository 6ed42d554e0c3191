"""Resume text: contacts, links, name, headline, location, skills, education and tenure from lines and sections.

Input is a table of pages (file, page_no, text), a text file, or whatever `decode_pdf` makes of a PDF's bytes. Section
state is carried along the lines of a document inside aggregate(), so a document stays one row.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import lookup
from ..functions.text import computed, strip, words
from .notes import EMAIL, TITLE_WORDS, found, has_any, phones_in
from .registry import FILE, empty, files_of, in_order, many, one, register, value, values

# Fixed patterns of the text format.
URL = r"(?i)https?://[^\s,;|]+"
SOCIAL = r"(?i)(?:https?://)?(?:www\.)?(?:github|linkedin)\.com/[^\s,;|]+"
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
MON = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE = rf"{MON}\s+\d{{4}}|\d{{4}}[/-]\d{{1,2}}(?!\d)|\d{{1,2}}[/-]\d{{4}}(?!\d)|\d{{4}}(?!\d)"
PRESENT = r"present\s*day|present|current|now|ongoing|till\s*date|to\s*date"
RANGE = rf"(?i)(?<!\d)({DATE})\s*(?:--?|–|—|to|until|through|thru)\s*((?:{DATE})|{PRESENT})"
SECTION = r"(?i)^\s*(?:skills|experience|education|projects|work|employment|certifications|summary|contact|achievements|interests|languages|publications)\b.*:?\s*$"
EXPERIENCE = r"(?i)^\s*(?:experience|work|employment)"
EDUCATION = r"(?i)^\s*(?:education|academic|qualifications?)\b"
SKILLS = (
    r"(?i)^\s*(?:key|core|technical|professional|relevant|additional|other|primary|software|computer|it|programming|languages?)?\s*"
    r"(?:technical\s+skills|tech\s+stack|tech\s+skills|core\s+competenc(?:y|ies)|core\s+skills|programming\s+languages|skills\s*&?\s*tools"
    r"|tools\s*&?\s*technologies|areas?\s+of\s+expertise|technologies|competenc(?:y|ies)|proficienc(?:y|ies)|skill\s*set|skillset|skills)"
    r"\b(?:\s*:.*)?\s*$"
)
DEGREE = (
    r"(?i)(?<![A-Za-z])(?:b\.?s|m\.?s|b\.?a|m\.?a|b\.?tech|m\.?tech|b\.?e|m\.?e|b\.?sc|m\.?sc|ph\.?d|m\.?phil|mba|bachelor|master|diploma|associate|degree)"
)
SKILL_SPLIT = r"[,;•|/]| - "
NOT_A_PLACE = r":|\.[a-z]"

#: Turns a PDF's bytes into the text of its pages; there is no PDF library here, so callers set their own.
decode_pdf: Callable[[bytes], list[str]] | None = None


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def _none() -> Column:
    return F.array().cast("array<string>")


def _name_like(line: Column) -> Column:
    n, letters = F.size(words(line)), F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return ~line.rlike("[@,]") & ~F.lower(line).contains("http") & n.between(1, 4) & (letters >= F.greatest(F.lit(3), F.length(line) - n - 2))


def _skill_parts(text: Column) -> Column:
    parts = F.transform(F.split(text, SKILL_SPLIT), lambda p: strip(strip(strip(p), r"\-•*▪◦· \t")))
    return F.filter(parts, lambda p: p != "")


def _is_category(line: Column) -> Column:
    rest = F.regexp_extract(line, r"^[^:]*:(.*)$", 1)
    head = F.regexp_extract(line, r"^([^:]*):", 1)
    return line.contains(":") & (strip(rest) != "") & (F.size(words(head)) <= 3) & rest.rlike(SKILL_SPLIT)


def _after_colon(line: Column) -> Column:
    return F.regexp_extract(line, r"^[^:]*:(.*)$", 1)


def _skills(lines: Column) -> Column:
    start = F.struct(_none().alias("got"), F.lit(False).alias("inside"))

    def step(s: Column, line: Column) -> Column:
        header, section, category = line.rlike(SKILLS), line.rlike(SECTION), _is_category(line)
        text = F.when(header | category, _after_colon(line)).otherwise(line)
        take = header | (s["inside"] & (category | ~section))
        inside = header | (s["inside"] & (category | ~section))
        return F.struct(F.when(take, F.concat(s["got"], _skill_parts(text))).otherwise(s["got"]).alias("got"), inside.alias("inside"))

    return F.array_distinct(F.aggregate(lines, start, step, lambda s: s["got"]))


def _section_lines(lines: Column, is_header: Callable[[Column], Column], opens: Callable[[Column], Column]) -> Column:
    """The non-empty lines of the sections whose header opens them."""
    start = F.struct(_none().alias("got"), F.lit(False).alias("inside"))

    def step(s: Column, line: Column) -> Column:
        header = is_header(line)
        got = F.when(~header & s["inside"] & (line != ""), F.array_append(s["got"], line)).otherwise(s["got"])
        return F.struct(got.alias("got"), F.when(header, opens(line)).otherwise(s["inside"]).alias("inside"))

    return F.aggregate(lines, start, step, lambda s: s["got"])


def endpoint(token: Column, as_of: date) -> Column:
    """Months since year 0 of one end of a range, or null."""

    def month_of(t: Column) -> Column:
        named = F.regexp_extract(t, rf"^({MON})\s+(\d{{4}})", 2).try_cast("int") * 12 + lookup(MONTHS, F.substring(t, 1, 3), F.lit(None).cast("int")) - 1

        def of_numbers(pair: Column) -> Column:
            a, b = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
            year, month = F.when(F.length(a) == 4, a).otherwise(b).try_cast("int"), F.when(F.length(a) == 4, b).otherwise(a).try_cast("int")
            both = F.when((F.size(pair) == 2) & month.between(1, 12), year * 12 + month - 1)
            alone = F.when((F.size(pair) == 1) & (F.length(a) == 4), a.try_cast("int") * 12)
            return F.coalesce(both, alone)

        numbers = computed(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), of_numbers)
        return F.when(t.rlike(f"^(?:{PRESENT})"), F.lit(as_of.year * 12 + as_of.month - 1)).when(t.rlike(rf"^{MON}\s+\d{{4}}"), named).otherwise(numbers)

    return computed(F.lower(strip(token)), month_of)


def _ranges(line: Column, as_of: date) -> Column:
    lo, hi = (F.regexp_extract_all(line, F.lit(RANGE), F.lit(g)) for g in (1, 2))
    pairs = F.transform(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda p: F.struct(endpoint(p["lo"], as_of).alias("lo"), endpoint(p["hi"], as_of).alias("hi")))
    return F.when(line.rlike(RANGE), pairs).otherwise(F.array().cast("array<struct<lo: int, hi: int>>"))


def union_months(intervals: Column) -> Column:
    """Months covered by inclusive intervals (lo, hi), overlaps once: sorted, and folded with the end reached so far."""
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("end"))

    def step(s: Column, i: Column) -> Column:
        return F.struct((s["total"] + F.greatest(F.lit(0), i["hi"] - F.greatest(i["lo"], s["end"] + 1) + 1)).alias("total"), F.greatest(s["end"], i["hi"]).alias("end"))

    return F.aggregate(F.array_sort(intervals), start, step, lambda s: s["total"])


def _as_month(m: Column) -> Column:
    return F.when(m.isNotNull(), F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int")))


def _education(line: Column, as_of: date) -> Column:
    text = F.regexp_replace(F.regexp_replace(line, r"\([^)]*\)", " "), RANGE, " ")
    parts = F.filter(F.transform(F.split(text, r",|—|–|\||•| - "), lambda p: strip(p, " .")), lambda p: p != "")

    def item(x: Column) -> Column:
        rest, span = x["rest"], x["span"]
        return F.struct(_first(rest).alias("institution"), x["degree"].alias("degree"), F.get(rest, F.lit(1)).alias("field_of_study"), _as_month(span["lo"]).alias("start"), _as_month(span["hi"]).alias("end"))

    def split(x: Column) -> Column:
        rest = F.filter(x["parts"], lambda p, i: x["degree"].isNull() | ((i + 1) != F.array_position(x["parts"], x["degree"])))
        return computed(F.struct(rest.alias("rest"), x["degree"].alias("degree"), _first(_ranges(line, as_of)).alias("span")), item)

    of = lambda ps: F.struct(ps.alias("parts"), _first(F.filter(ps, lambda p: p.rlike(DEGREE))).alias("degree"))
    return computed(parts, lambda ps: computed(of(ps), split))


def parse_documents(docs: DataFrame, as_of: date | None = None) -> DataFrame:
    """RAW_VALUES rows of documents (record_ord, text). as_of is what "present" means, in experience and education."""
    as_of = as_of or date.today()
    docs = docs.filter(strip(F.col("text")) != "")
    docs = docs.withColumn("lines", F.transform(F.split("text", r"\R"), lambda s_: strip(s_)))
    docs = docs.withColumn("full", F.filter("lines", lambda x: x != ""))
    header = lambda x: x.rlike(SECTION)
    at = F.transform(F.slice("full", 1, 5), lambda x, i: F.when(~header(x) & _name_like(x), i))
    docs = docs.withColumn("at", _first(F.filter(at, lambda i: i.isNotNull())))
    docs = docs.withColumn("name", F.get("full", F.col("at"))).withColumn("after", F.coalesce(F.col("at") + 1, F.lit(0)))
    text, lines, after = F.col("text"), F.col("lines"), F.col("after") + 1
    many_items = lambda x: x.rlike(NOT_A_PLACE) | ((F.length(x) - F.length(F.regexp_replace(x, r"[,|]", ""))) >= 3)
    headline = _first(F.filter(F.slice("full", after, F.lit(4)), lambda x: ~x.contains("@") & ~header(x) & ~many_items(x) & has_any(F.lower(x), TITLE_WORDS)))
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    place = _first(F.filter(F.slice("full", after, F.lit(6)), lambda x: ~x.contains("@") & ~F.lower(x).contains("http") & ~header(x) & ~x.rlike(NOT_A_PLACE) & x.contains(",") & (digits(x) <= 2) & ~has_any(F.lower(x), TITLE_WORDS)))
    jobs = _section_lines(lines, header, lambda x: x.rlike(EXPERIENCE))
    spans = F.filter(F.flatten(F.transform(jobs, lambda x: _ranges(x, as_of))), lambda p: p["lo"].isNotNull() & p["hi"].isNotNull() & (p["hi"] >= p["lo"]))
    # columns of their own, which are used more than once: inside the rows' array each use would compute them again
    docs = docs.withColumn("spans", spans)
    docs = docs.withColumn("tenure", F.when(F.size("spans") > 0, F.round(F.bround(union_months(F.col("spans")) / F.lit(12.0), 1), 1)))
    tenure = F.col("tenure")
    total = F.when(tenure == F.floor(tenure), F.floor(tenure).cast("string")).otherwise(tenure.cast("string"))
    phrase = F.nullif(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*\+?\s*years?", 1), F.lit(""))
    schools = _section_lines(lines, lambda x: x.rlike(SKILLS) | header(x) | x.rlike(EDUCATION), lambda x: x.rlike(EDUCATION))
    items = F.filter(F.transform(schools, lambda x: _education(x, as_of)), lambda e: e["institution"].isNotNull() | e["degree"].isNotNull())
    urls = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1)), F.regexp_extract_all(text, F.lit(f"({SOCIAL})"), F.lit(1))))
    return values(docs, "Resume", [
        one("full_name", F.col("name"), "pdf_text"),
        one("headline", headline, "pdf_text"),
        one("location", place, "pdf_text"),
        one("years_experience", F.coalesce(total, phrase), F.when(total.isNotNull(), "pdf_experience_sum").otherwise("pdf_regex")),
        many("emails", found(text, EMAIL), "pdf_regex"),
        many("phones", phones_in(text), "pdf_regex"),
        many("links", urls, "pdf_regex"),
        many("skills", _skills(lines), "pdf_section"),
        F.transform(items, lambda e, i: value("education", F.to_json(e), "pdf_section", i, e)),
    ])


def join_pages(pages: DataFrame) -> DataFrame:
    """Documents (file, text) of pages (file, page_no, text)."""
    return pages.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "text")))["text"], "\n").alias("text"))


@register("resume_pdf")
def read_resume(spark: SparkSession, path: str) -> DataFrame:
    """One record a file: text files, and PDF files if there is a decoder."""
    if path.endswith(".txt"):
        text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col(FILE).alias("file"))
        return parse_documents(in_order(text.withColumn("at", F.lit(0)), files_of(text)).select("record_ord", "text"))
    decode = decode_pdf
    if decode is None:
        return empty(spark)
    scan = spark.read.format("binaryFile").load(path)
    files = scan.select(F.col(FILE).alias("file"), "content")

    def pages(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["file"], b["content"], strict=True):
                try:
                    texts = decode(content)
                except Exception:  # noqa: BLE001  an unreadable file has no pages
                    texts = []
                yield pd.DataFrame({"file": [p] * len(texts), "page_no": range(len(texts)), "text": texts})

    docs = join_pages(files.mapInPandas(pages, "file string, page_no int, text string")).withColumn("at", F.lit(0))
    return parse_documents(in_order(docs, files_of(scan)).select("record_ord", "text"))


def diagnose(docs: DataFrame) -> DataFrame:
    """line_no, line and tag of every non-empty line of documents (record_ord, text): what the parser takes for a header of skills, education or another section."""
    lines = docs.select("record_ord", F.posexplode(F.split("text", r"\R")).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    x = F.col("line")
    return lines.withColumn("tag", F.when(x.rlike(SKILLS), "skills header").when(x.rlike(EDUCATION), "education header").when(x.rlike(SECTION), "section header"))
