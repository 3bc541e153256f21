"""Keyword and pattern rules: data tables, and the expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Keyword lists in order of precedence.
DOC_TYPE_KEYWORDS = {
    "DRIVERS_LICENSE": ["driver", "licence", "license", "driving", "motor vehicle", "dmv", "class", "endorsements", "restrictions", "lic no", "license no", "ltd-term", "limited-term"],
    "PASSPORT": ["passport", "travel document", "p<", "nationality", "place of birth", "date of issue", "authority"],
    "BIRTH_CERTIFICATE": ["birth certificate", "certificate of birth", "registration no", "place of birth", "father", "mother", "registrar"],
    "INSURANCE": ["insurance", "policy", "premium", "coverage", "beneficiary", "insured", "policyholder"],
    "MEDICAL_RECORD": ["patient", "diagnosis", "prescription", "hospital", "physician", "medications", "clinic"],
}
DATE_HINT = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
STATE_HINT = r"\b(AZ|CA|NY|TX|FL|BC|ON|AB|QC)\b"
BIRTH_HINT = r"dob|birth|born|poe|poc"

INTENT_KEYWORDS = {
    "claim_status": ["denied", "denial", "authorization", "prior auth", "p2p", "peer to peer", "claim", "rejected", "not covered", "coverage denied"],
    "cost_estimate": ["how much", "cost", "owe", "estimate", "out of pocket", "deductible", "copay", "coinsurance", "what will i pay"],
    "pre_procedure": ["before", "prep", "preparation", "fasting", "fast", "eat", "drink", "medication", "stop taking", "blood thinner", "arrive", "what time", "what should i"],
    "bill_explain": ["bill", "statement", "charge", "invoice", "why do i owe", "balance", "payment", "pay my bill", "received a bill"],
}
GOODBYE_KEYWORDS = ["bye", "goodbye", "thank you that's all", "that's all", "hang up", "no more questions", "nothing else", "thanks bye"]
OPEN_ENDED_KEYWORDS = ["how many", "list all", "show all", "count", "every", "total", "all people", "all entities", "all records", "what documents", "summarize everyone", "how many licenses", "how many passports"]

ANSWER_KEYWORDS = {
    "dob": ["dob", "birth", "born", "birthday"],
    "license_number": ["license", "licence", "driving"],
    "passport_number": ["passport"],
    "address": ["address", "live", "home"],
    "policy_number": ["insurance", "policy"],
    "diagnosis": ["diagnosis", "medical", "condition"],
    "medications": ["medication", "drug", "prescription"],
}
PREP_KEYWORDS = {
    "colonoscopy": ["colonoscopy", "colon", "endoscopy", "bowel"],
    "surgery": ["surgery", "surgical", "operation", "arthroscopy", "fusion", "bypass"],
    "cardiac": ["cardiac", "heart", "coronary", "catheter"],
    "imaging": ["mri", "ct scan", "x-ray", "imaging", "scan", "ultrasound"],
}
#: Encounter types that fall back to the instructions for surgery.
PREP_TYPES = ["inpatient", "emergency"]

ANSWER_STATUS_KEYWORDS = {
    "DENIED_NO_PA": ["DENIED_NO_PA", "prior authorization was not obtained"],
    "PENDING_P2P": ["PENDING_P2P", "Peer-to-Peer"],
    "PARTIAL": ["partially covered", "PARTIAL"],
    "PAID": ["fully processed", "PAID"],
}
MENU = {
    "1": "Claims and billing. Please hold while I transfer you.",
    "2": "Prior authorization. Please hold while I transfer you.",
    "3": "Eligibility and benefits. Please hold while I transfer you.",
    "0": "Agent. Please hold while I transfer you.",
}
MENU_DEFAULT = "Invalid selection. Please try again."

DOC_TYPE_ALIASES = {
    "BIRTH_CERTIFICATE": "BIRTH_CERTIFICATE",
    "DRIVERS_LICENSE": "DRIVERS_LICENSE",
    "DRIVER_LICENSE": "DRIVERS_LICENSE",
    "PASSPORT": "PASSPORT",
    "INSURANCE": "INSURANCE",
    "MEDICAL_RECORD": "MEDICAL_RECORD",
    "GENERIC": "GENERIC",
}
EXTRACTOR_ALIASES = {"id_cards": "DRIVERS_LICENSE", "passports": "PASSPORT", "invoices": "INSURANCE"}
DOC_TYPES = ["BIRTH_CERTIFICATE", "DRIVERS_LICENSE", "PASSPORT", "INSURANCE", "MEDICAL_RECORD", "MEDICAL_REPORT", "GENERIC"]

# Tables and patterns of the field extractor.
EYE_COLOURS = {"BRN": "Brown", "BLU": "Blue", "GRN": "Green", "HAZ": "Hazel", "GRY": "Gray", "BLK": "Black", "AMB": "Amber"}
COUNTRIES = {"IND": "Indian", "USA": "American", "CAN": "Canadian", "GBR": "British", "AUS": "Australian"}
NOT_NAMES = ["ARIZONA", "DRIVER", "LICENSE", "CLASS", "NONE", "ENDORSEMENTS", "RESTRICTIONS", "OPERATOR", "LIMITED", "TERM", "IND", "INDIAN", "PASSPORT", "VISA", "TYPE", "CODE", "SEX", "HGT", "WGT", "REV", "DOB", "ISS", "EXP", "DL", "ID", "ENON", "COIMBATORE"]
DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
DOB_LABEL = r"(?i)\b(?:poe|poc|dob|date\s+of\s+birth|birth\s+date)\b[^0-9]*(\d{1,2}/\d{1,2}/\d{4})"
EXPIRY_LABEL = r"(?i)\b(?:exe|exp|expires?|expiry|date\s+of\s+expiry)\b[^0-9]*(\d{1,2}/\d{1,2}/\d{4})"
ISSUE_LABEL = r"(?i)\b(?:iss|saiss|issued?|issue\s+date|date\s+of\s+[it]ssue)\b[^0-9]*(\d{1,2}/\d{1,2}/\d{4})"
LICENSE_NUMBER = r"\b([A-Z][0-9]{7,9})\b"
MRZ_NAMES = r"P<([A-Z]{3})([A-Z<]{5,})"
MRZ_NUMBERS = r"([A-Z][A-Z0-9]{6,8})<\d[1I][A-Z]{2}(\d{6})\d[MF](\d{6})"
BIRTHPLACE = r"(?i)(?:place\s+of\s+birth|birthplace|pob)[:\s]+([A-Za-z][A-Za-z\s,]+?)(?:\s{2,}|$|\n)"
BIRTHPLACE_CITY = r"(?i)\b(COIMBATORE(?:[,\s]+TAMIL\s+NADU)?)\b"
CLASS = r"(?i)\bCLASS\s+([A-D])\b"
STATE = r"\b(AZ|CA|NY|TX|FL|BC|ON|AB|QC|ARIZONA)\b"
HEIGHTS = (r"(?i)\bHGT\s+([0-9]{2,3})\b", r"(?i)(?:height|hgt)[:\s]+([0-9]{2,3})")
WEIGHTS = (r"(?i)\bWGT\s+([0-9]{2,3})\b", r"(?i)(?:weight|wgt)[:\s]+([0-9]{2,3})\s*(?:lbs?|kg)?")
EYES = (r"\b(BRN|BLU|GRN|HAZ|GRY|BLK|AMB)\b", r"(?i)(?:eyes?|eye\s*color)[:\s]+([A-Z]{3,8})\b")
SEXES = (r"\bSEX\s+([MF])\b", r"(?i)(?:sex|gender)[:\s]+([MF](?:ale|emale)?)\b")
ADDRESS = r"([A-Z][a-zA-Z\s]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)"


def any_of(c: Column, keywords: list[str]) -> Column:
    """Whether the text holds one of the keywords."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(c, F.lit(k))
    return out


def any_word_of(c: Column, keywords: list[str]) -> Column:
    """Whether the text holds one of the keywords between word boundaries."""
    return c.rlike(r"\b(" + "|".join(keywords) + r")\b")


def first_of(c: Column, table: dict[str, list[str]], default: Column | str | None = None) -> Column:
    """The first entry of the table of which the text holds a keyword."""
    out = None
    for name, keywords in table.items():
        out = (F if out is None else out).when(any_of(c, keywords), name)
    return out.otherwise(default) if default is not None else out


def doc_type(text: Column) -> Column:
    low = F.lower(text)
    dated = text.rlike(DATE_HINT) & (text.rlike(STATE_HINT) | low.rlike(BIRTH_HINT))
    return first_of(low, DOC_TYPE_KEYWORDS, F.when(dated, "DRIVERS_LICENSE").otherwise("GENERIC"))


def intent(text: Column) -> Column:
    return first_of(F.lower(text), INTENT_KEYWORDS, "general")


def is_goodbye(text: Column) -> Column:
    return any_of(F.lower(text), GOODBYE_KEYWORDS)


def is_open_ended(text: Column) -> Column:
    """By whole words, so that ``account`` does not ask for a count."""
    return any_word_of(F.lower(text), OPEN_ENDED_KEYWORDS)


def answer_attributes(question: Column) -> Column:
    """Names of the attributes that the question is about."""
    low = F.lower(question)
    return F.filter(F.array(*[F.when(any_of(low, k), a) for a, k in ANSWER_KEYWORDS.items()]), lambda a: a.isNotNull())


def prep_kind(description: Column, encounter_type: Column) -> Column:
    by_type = F.when(any_of(F.lower(encounter_type), PREP_TYPES), "surgery").otherwise("default")
    return first_of(F.lower(description), PREP_KEYWORDS, by_type)


def answer_status(answer: Column) -> Column:
    return first_of(answer, ANSWER_STATUS_KEYWORDS, "default")


def menu_response(selection: Column) -> Column:
    return lookup(selection, MENU, F.lit(MENU_DEFAULT))


def lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, v)
    return out.otherwise(default)


def alias_doc_type(raw: Column) -> Column:
    return lookup(F.upper(tx.strip(raw)), DOC_TYPE_ALIASES, F.lit("GENERIC"))


def extractor_doc_type(label: Column, extractor: Column) -> Column:
    """By the label first, then by the extractor's name."""
    a, b = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(extractor, F.lit("")))
    by_label = F.when(any_of(a, ["passport"]), "PASSPORT").when(any_of(a, ["driver", "license", "licence"]), "DRIVERS_LICENSE")
    by_name = F.when(any_of(b, ["passport"]), "PASSPORT").when(any_of(b, ["id_card", "id-card"]), "DRIVERS_LICENSE").when(any_of(b, ["invoice"]), "INSURANCE")
    return F.coalesce(by_label, by_name, lookup(extractor, EXTRACTOR_ALIASES, F.lit("GENERIC")))


def reply_label(raw: Column) -> Column:
    """The type that a model's reply names: alone, or somewhere in it; else GENERIC."""
    up = F.upper(tx.strip(raw))
    return F.when(up.isin(DOC_TYPES), up).otherwise(first_of(up, {t: [t] for t in DOC_TYPES}, "GENERIC"))


def found(c: Column, *patterns: str) -> Column:
    """What the first pattern that occurs captures; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def _date_roles(clean: Column) -> dict[str, Column]:
    year = lambda d: F.element_at(F.split(d, "/"), 3).cast("int")
    dates = F.transform(F.array_sort(F.transform(F.regexp_extract_all(clean, F.lit(DATE), F.lit(1)), lambda d: F.struct(year(d).alias("y"), d.alias("d")))), lambda s: s["d"])
    n = F.size(dates)
    three = F.when(n == 3, F.get(dates, F.lit(0)))
    return {
        "dob": F.coalesce(found(clean, DOB_LABEL), three),
        "expiry_date": F.coalesce(F.when(n >= 2, F.element_at(dates, -1)), found(clean, EXPIRY_LABEL)),
        "issue_date": F.coalesce(found(clean, ISSUE_LABEL), F.when(n == 3, F.get(dates, F.lit(1))).when(n == 2, F.get(dates, F.lit(0)))),
    }


def _name_from_lines(text: Column) -> Column:
    """Given name and surname from the first two lines that are one word in capitals."""
    line = lambda x: tx.strip(F.regexp_replace(tx.strip(F.regexp_replace(x, r"^[\d\W_]+", "")), r"^[a-z]{1,3}\s+", ""))
    word = lambda x: F.regexp_extract(line(x), r"^([A-Z]{3,25})", 1)
    rest = lambda x: F.regexp_replace(F.substring(line(x), F.length(word(x)) + 1, F.length(x) + F.lit(1)), r"[^a-zA-Z]", "")
    mended = lambda x: F.concat(word(x), F.when(F.endswith(word(x), F.lit("A")) & F.endswith(tx.strip(x), F.lit("\\")), "J").otherwise(""))
    caps = F.transform(F.filter(tx.lines(text), lambda x: (word(x) != "") & (F.length(rest(x)) <= 3)), mended)
    caps = F.filter(caps, lambda w: ~w.isin(NOT_NAMES))
    return F.when(F.size(caps) >= 2, F.initcap(F.concat_ws(" ", F.get(caps, F.lit(1)), F.get(caps, F.lit(0))))).when(F.size(caps) == 1, F.initcap(F.get(caps, F.lit(0))))


def _short_year(digits: Column, pivot: int) -> Column:
    """MM/DD/YYYY of YYMMDD; years up to the pivot are of this century."""
    yy = F.substring(digits, 1, 2)
    year = F.concat(F.when(yy.try_cast("int") <= pivot, "20").otherwise("19"), yy)
    return F.when(digits != "", F.concat_ws("/", F.substring(digits, 3, 2), F.substring(digits, 5, 2), year))


def extract_fields(text: Column) -> dict[str, Column]:
    """Field -> expression; null where the text does not have it."""
    clean = F.array_join(F.filter(F.transform(tx.lines(text), tx.strip), lambda x: x != ""), " ")
    roles = _date_roles(clean)
    names = F.regexp_extract(clean, MRZ_NAMES, 2)
    parts = F.split(names, "<<", -1)
    given = F.filter(F.split(F.get(parts, F.lit(1)), "<"), lambda t: t.rlike("^[A-Z]{4,}$"))
    longest = F.array_max(F.transform(given, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    surname = F.get(F.split(F.get(parts, F.lit(0)), "<"), F.lit(0))
    mrz_name = F.when((surname != "") & longest.isNotNull(), F.initcap(F.concat_ws(" ", longest, surname)))
    numbers = [F.regexp_extract(clean, MRZ_NUMBERS, i) for i in (1, 2, 3)]
    country = found(clean, MRZ_NAMES)
    height, weight, eyes, sex, state = (found(clean, *p) for p in (HEIGHTS, WEIGHTS, EYES, SEXES, (STATE,)))
    return {
        "license_number": found(clean, LICENSE_NUMBER),
        "dob": F.coalesce(roles["dob"], _short_year(numbers[1], 30)),
        "expiry_date": F.coalesce(roles["expiry_date"], _short_year(numbers[2], 50)),
        "issue_date": roles["issue_date"],
        "name": F.coalesce(_name_from_lines(text), mrz_name),
        "nationality": lookup(country, COUNTRIES, country),
        "passport_number": F.nullif(numbers[0], F.lit("")),
        "place_of_birth": F.initcap(tx.strip(F.coalesce(found(text, BIRTHPLACE), found(clean, BIRTHPLACE_CITY)))),
        "class": F.upper(found(clean, CLASS)),
        "state": F.when(state == "ARIZONA", "AZ").otherwise(state),
        "height": F.concat(F.substring(height, 1, 1), F.lit("'"), F.substring(height, 2, 2), F.lit('"')),
        "weight": F.concat(weight, F.lit(" lbs")),
        "eye_color": lookup(F.upper(eyes), EYE_COLOURS, F.initcap(eyes)),
        "sex": F.when(F.startswith(F.upper(sex), F.lit("M")), "Male").when(sex.isNotNull(), "Female"),
        "address": tx.strip(found(clean, ADDRESS)),
    }
