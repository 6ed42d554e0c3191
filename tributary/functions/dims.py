"""Fixed lookup values of the normalizers, as literals for Catalyst maps."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Skill aliases.
SKILL_ALIASES = {
    "ml": "Machine Learning", "machine-learning": "Machine Learning", "machine learning": "Machine Learning",
    "ai": "Artificial Intelligence", "artificial-intelligence": "Artificial Intelligence",
    "dl": "Deep Learning", "deep-learning": "Deep Learning", "nlp": "Natural Language Processing", "cv": "Computer Vision",
    "py": "Python", "python3": "Python", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript",
    "reactjs": "React", "react.js": "React", "react": "React", "nextjs": "Next.js", "next.js": "Next.js",
    "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "psql": "PostgreSQL", "mongo": "MongoDB", "mongodb": "MongoDB",
    "k8s": "Kubernetes", "kubernetes": "Kubernetes", "docker": "Docker",
    "aws": "AWS", "gcp": "Google Cloud Platform", "azure": "Microsoft Azure",
    "tf": "TensorFlow", "tensorflow": "TensorFlow", "torch": "PyTorch", "pytorch": "PyTorch",
    "sklearn": "scikit-learn", "scikit-learn": "scikit-learn", "scikit learn": "scikit-learn",
    "golang": "Go", "go": "Go", "cpp": "C++", "c++": "C++", "csharp": "C#", "c#": "C#",
    "rest": "REST APIs", "restful": "REST APIs", "graphql": "GraphQL",
}

# City aliases.
CITY_ALIASES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "bombay": "Mumbai", "mumbai": "Mumbai", "calcutta": "Kolkata",
    "kolkata": "Kolkata", "madras": "Chennai", "chennai": "Chennai", "gurgaon": "Gurugram", "gurugram": "Gurugram",
    "poona": "Pune", "pune": "Pune", "trivandrum": "Thiruvananthapuram", "mysore": "Mysuru", "mangalore": "Mangaluru",
}

# Common names that are not ISO 3166's own, and some regions. ISO's codes and English names come from the JVM's tables.
COUNTRY_ALIASES = {
    "usa": "US", "america": "US", "united states of america": "US", "texas": "US", "california": "US", "new york": "US", "washington": "US",
    "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "deutschland": "DE", "holland": "NL",
    "turkey": "TR", "turkiye": "TR", "czech republic": "CZ", "russian federation": "RU", "viet nam": "VN", "korea": "KR", "burma": "MM",
    "ivory coast": "CI", "macedonia": "MK", "swaziland": "SZ", "cape verde": "CV", "bolivia": "BO", "venezuela": "VE", "tanzania": "TZ",
    "syria": "SY", "laos": "LA", "brunei": "BN", "moldova": "MD", "vatican": "VA", "hong kong": "HK", "macau": "MO", "macao": "MO", "uae": "AE",
}
# Official names that the rule below does not lead to their country.
OFFICIAL_NAMES = {
    "democratic people's republic of korea": "KP", "democratic republic of the congo": "CD", "republic of the congo": "CG", "republic of china": "TW",
    "united kingdom of great britain and northern ireland": "GB", "great britain and northern ireland": "GB", "lao people's democratic republic": "LA",
    "hellenic republic": "GR", "swiss confederation": "CH", "argentine republic": "AR", "french republic": "FR", "italian republic": "IT",
    "portuguese republic": "PT", "slovak republic": "SK", "syrian arab republic": "SY", "kyrgyz republic": "KG", "gabonese republic": "GA",
    "togolese republic": "TG", "hashemite kingdom of jordan": "JO", "state of japan": "JP", "holy see": "VA",
}
#: What stands before the name of a country in its official name.
OFFICIAL_FORM = (
    r"^(?:the )?(?:(?:islamic|democratic|socialist|people's|federal|federative|united|cooperative|co-operative|plurinational|bolivarian|oriental|independent|arab|grand) )*"
    r"(?:republic|kingdom|states?|commonwealth|principality|sultanate|duchy|union|federation) of (?:the )?"
)
# First-level regions by country, but for those that are named like a country or a city.
REGIONS = {
    "US": "alabama alaska arizona arkansas california colorado connecticut delaware florida hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland"
    " massachusetts michigan minnesota mississippi missouri montana nebraska nevada new_hampshire new_jersey new_mexico north_carolina north_dakota ohio oklahoma oregon"
    " pennsylvania rhode_island south_carolina south_dakota tennessee texas utah vermont virginia west_virginia wisconsin wyoming",
    "CA": "ontario british_columbia alberta manitoba saskatchewan nova_scotia new_brunswick prince_edward_island newfoundland_and_labrador yukon nunavut northwest_territories",
    "DE": "bavaria bayern baden-wurttemberg brandenburg hesse hessen lower_saxony niedersachsen north_rhine-westphalia nordrhein-westfalen rhineland-palatinate rheinland-pfalz"
    " saarland saxony sachsen saxony-anhalt sachsen-anhalt schleswig-holstein thuringia thuringen",
    "AU": "new_south_wales queensland tasmania south_australia western_australia northern_territory",
    "IN": "karnataka maharashtra tamil_nadu kerala telangana andhra_pradesh gujarat rajasthan punjab haryana uttar_pradesh madhya_pradesh west_bengal bihar odisha assam",
}
#: Letters with marks and the letters that they are matched by.
MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c))[0].isascii()} | {"\u2019": "'"}


@lru_cache(maxsize=1)
def country_codes() -> dict[str, str]:
    """Alpha-2 code by lower-case English name, alpha-2 and alpha-3 code of ISO 3166, and by the aliases."""
    jvm = SparkSession.active()._jvm.java.util
    found = {}
    for code in jvm.Locale.getISOCountries():
        at = jvm.Locale("", code)
        name = "".join(MARKED.get(c, c) for c in at.getDisplayCountry(jvm.Locale.ENGLISH)).lower().replace(".", "")
        found |= {name: code, name.replace("&", "and"): code, code.lower(): code, at.getISO3Country().lower(): code}
    return found | COUNTRY_ALIASES | OFFICIAL_NAMES


@lru_cache(maxsize=1)
def region_codes() -> dict[str, str]:
    """Alpha-2 code of the country of a first-level region."""
    return {name.replace("_", " "): code for code, names in REGIONS.items() for name in names.split()}


# Numbering plans: region, calling code, trunk prefix, and a pattern of valid national numbers.
CALLING_CODES = (
    ("IN", "91", "0", "[6-9][0-9]{9}|[1-5][0-9]{9}"),
    ("US", "1", "1", "[2-9](?:[02-8][0-9]|1[02-9])[2-9](?:[02-9][0-9]|1[02-9])[0-9]{4}"),
    ("CA", "1", "1", "[2-9](?:[02-8][0-9]|1[02-9])[2-9](?:[02-9][0-9]|1[02-9])[0-9]{4}"),
    ("GB", "44", "0", "7[1-57-9][0-9]{8}|[1-3][0-9]{8,9}|8[0-9]{9}"),
    ("DE", "49", "0", "1[5-7][0-9]{8,9}|[2-9][0-9]{5,10}"),
    ("FR", "33", "0", "[1-9][0-9]{8}"),
    ("ES", "34", "", "[6-9][0-9]{8}"),
    ("AU", "61", "0", "4[0-9]{8}|[2378][0-9]{8}"),
    ("SG", "65", "", "[3689][0-9]{7}"),
    ("JP", "81", "0", "[1-9][0-9]{8,9}"),
    ("BR", "55", "0", "[1-9][0-9]9?[0-9]{8}"),
    ("AE", "971", "0", "5[0-9]{8}|[2-9][0-9]{7}"),
)


# The other calling codes of E.164 by zone. Their numbers are taken for valid by their length.
OTHER_CODES = (
    "2(?:0|7|1[12368]|[23]\\d|4\\d|5[0-8]|6\\d|9[01789])|3(?:[0-69]|5\\d|7[0-8]|8[0-35-7])|4(?:[0135-8]|2[013])|5(?:[1-8]|0\\d|9\\d)"
    "|6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])|7|8(?:[1246]|5[02356]|8[06])|9(?:[0-58]|6[0-8]|7[0-7]|9[2-68])"
)
OTHER_NATIONAL = r"\d{6,12}"


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def lookup(values: dict, key: Column, default: Column) -> Column:
    """values[key], or the default where there is none: a hash lookup in a literal, no join."""
    return F.coalesce(F.try_element_at(literal_map(values), key), default)
