"""Raw values to normalized values: one projection over the long table, dispatched by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dims import literal_map
from ..model import COLLECTIONS, EDUCATION, SCALARS, FusionConfig


def _quoted(x: Column) -> Column:
    """A text as Python shows it inside a record: the tie-break of equal candidates sorts by this."""
    q = F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(q, F.lit("None"))


def normalize(raw: DataFrame, config: FusionConfig = FusionConfig(), fields: tuple[str, ...] = (*SCALARS, *COLLECTIONS)) -> DataFrame:
    """record_ord, source, field, pos, method, raw, malformed and the value: v_key (equal values have equal keys), v_str, v_num, v_loc, v_link, v_edu;
    with what the merge sorts by: tiebreak, completeness, priority, base. Rows of other fields than the named ones are left out."""
    f, x = F.col("field"), F.col("raw")
    rows = raw.filter(f.isin(*fields) & (x.isNotNull() | F.col("edu").isNotNull()))
    case = {"emails": t.email(x), "phones": t.phone(x, config.region), "skills": t.skill(x), "full_name": t.name(x), "headline": t.name(x)}
    text_value, text_ok = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, r in ((k, v) for k, v in case.items() if k in fields):
        text_value, text_ok = F.when(f == name, r["value"]).otherwise(text_value), F.when(f == name, r["ok"]).otherwise(text_ok)
    none = lambda kind: t.result(F.lit(None).cast(kind), F.lit(False))
    years = t.years(x) if "years_experience" in fields else none("struct<num: double, text: string>")
    place = t.location(x) if "location" in fields else none(t.LOCATION)
    link = t.link(x) if "links" in fields else none(t.LINK)
    rows = rows.withColumns(
        {
            "v_str": F.when(f == "years_experience", years["value"]["text"]).otherwise(text_value),
            "v_num": F.when(f == "years_experience", years["value"]["num"]),
            "v_loc": F.when(f == "location", place["value"]),
            "v_link": F.when(f == "links", link["value"]),
            "v_edu": F.when(f == "education", F.col("edu")).cast(EDUCATION),
            "ok": F.when(f == "years_experience", years["ok"]).when(f == "location", place["ok"]).when(f == "links", link["ok"]).when(f == "education", F.lit(True)).otherwise(text_ok),
        }
    )
    rows = rows.filter(F.coalesce(F.col("v_str"), F.lit("x")) != "")
    loc, link_, edu = F.col("v_loc"), F.col("v_link"), F.col("v_edu")
    filled = lambda s, names: sum((s[n].isNotNull().cast("int") for n in names), F.lit(0))
    # Python writes whole floats up to 1e16 as 5.0 and not in exponents
    number = F.when(F.col("v_num") == F.floor("v_num"), F.concat(F.floor("v_num").cast("string"), F.lit(".0"))).otherwise(F.col("v_num").cast("string"))
    show_loc = F.concat(F.lit("Location(city="), _quoted(loc["city"]), F.lit(", region="), _quoted(loc["region"]), F.lit(", country="), _quoted(loc["country"]), F.lit(")"))
    show_link = F.concat(F.lit("Link(kind="), _quoted(link_["kind"]), F.lit(", url="), _quoted(link_["url"]), F.lit(", handle="), _quoted(link_["handle"]), F.lit(")"))
    show = F.coalesce(F.col("v_str"), number, F.when(loc.isNotNull(), show_loc), F.when(link_.isNotNull(), show_link), F.to_json(edu))
    return rows.select(
        "record_ord", "source", "field", "pos", "method", "raw",
        (F.col("malformed") | ~F.coalesce(F.col("ok"), F.lit(False))).alias("malformed"),
        "v_str", "v_num", "v_loc", "v_link", "v_edu",
        F.concat_ws(":", F.when(F.col("v_num").isNotNull(), "n").otherwise("s"), show).alias("v_key"),
        show.alias("tiebreak"),
        F.when(loc.isNotNull(), filled(loc, ("city", "region", "country"))).when(link_.isNotNull(), F.length(link_["url"])).when(edu.isNotNull(), filled(edu, ("institution", "degree", "field_of_study", "start", "end"))).when(F.col("v_num").isNotNull(), F.lit(1)).otherwise(F.length("v_str")).alias("completeness"),
        F.coalesce(F.try_element_at(literal_map(config.priority), F.col("source")), F.lit(50)).alias("priority"),
        F.coalesce(F.try_element_at(literal_map(config.base), F.col("source")), F.lit("0.50")).cast("decimal(6,4)").alias("base"),
    )
