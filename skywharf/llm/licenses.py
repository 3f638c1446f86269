"""License scans by ordered signature rules over the words of a text.

A rule is an expression over words, gated by its first word: only texts that hold the word, and only its places, are
tried. Rules are ordered; a detection inside the interval of a detection by an earlier rule is suppressed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words a rule may look at.
REACH = 24

#: Phrases that are always reported.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, names (short ones last), versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "general public licen[sc]e", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "lesser general public licen[sc]e", "gnu lgpl", "lgpl"), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl", "agpl"), ("1", "3")),
    ("gfdl", ("gnu free documentation licen[sc]e", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache software licen[sc]e", "apache licen[sc]e", "apache"), ("1 0", "1 1", "2 0", "2")),
    ("mit", ("mit x11 licen[sc]e", "mit licen[sc]e", "expat licen[sc]e", "mit"), ()),
    ("bsd-2-clause", ("bsd 2 clause( licen[sc]e)?", "simplified bsd licen[sc]e", "freebsd licen[sc]e"), ()),
    ("bsd-3-clause", ("bsd 3 clause( licen[sc]e)?", "modified bsd licen[sc]e", "revised bsd licen[sc]e"), ()),
    ("bsd-4-clause", ("bsd 4 clause( licen[sc]e)?", "original bsd licen[sc]e"), ()),
    ("bsd", ("bsd style licen[sc]e", "bsd licen[sc]e", "bsd"), ()),
    ("isc", ("isc licen[sc]e", "isc"), ()),
    ("zlib", ("zlib libpng licen[sc]e", "zlib licen[sc]e", "zlib"), ()),
    ("mpl", ("mozilla public licen[sc]e", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public licen[sc]e", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution licen[sc]e", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public licen[sc]e", "cpl"), ("1 0",)),
    ("ms-pl", ("microsoft public licen[sc]e", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal licen[sc]e", "ms rl"), ()),
    ("artistic", ("perl artistic licen[sc]e", "artistic licen[sc]e"), ("1 0", "2 0")),
    ("bsl", ("boost software licen[sc]e", "bsl"), ("1 0",)),
    ("busl", ("business source licen[sc]e", "busl"), ("1 1",)),
    ("eupl", ("european union public licen[sc]e", "eupl"), ("1 0", "1 1", "1 2")),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e", "ofl"), ("1 0", "1 1")),
    ("osl", ("open software licen[sc]e", "osl"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free licen[sc]e", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("psf", ("python software foundation licen[sc]e", "psf licen[sc]e", "psf"), ("2",)),
    ("php", ("php licen[sc]e",), ("3 0", "3 01")),
    ("zpl", ("zope public licen[sc]e", "zpl"), ("1 1", "2 0", "2 1")),
    ("odbl", ("open database licen[sc]e", "open data commons open database licen[sc]e", "odbl"), ("1 0",)),
    ("odc-by", ("open data commons attribution licen[sc]e", "odc by"), ("1 0",)),
    ("pddl", ("public domain dedication and licen[sc]e", "pddl"), ("1 0",)),
    ("cc-by-nc-nd", ("creative commons attribution non ?commercial no ?deriv[a-z]*( licen[sc]e)?", "cc by nc nd"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("creative commons attribution non ?commercial share ?alike( licen[sc]e)?", "cc by nc sa"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("creative commons attribution non ?commercial( licen[sc]e)?", "cc by nc"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("creative commons attribution no ?deriv[a-z]*( licen[sc]e)?", "cc by nd"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("creative commons attribution share ?alike( licen[sc]e)?", "cc by sa"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", ("creative commons attribution( licen[sc]e)?", "cc by"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("creative commons zero", "cc zero", "cc0"), ("1 0",)),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtf public licen[sc]e", "wtfpl"), ("2",)),
    ("postgresql", ("postgresql licen[sc]e",), ()),
    ("openssl", ("openssl licen[sc]e",), ()),
    ("ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa licen[sc]e"), ()),
    ("w3c", ("w3c software notice and licen[sc]e", "w3c licen[sc]e"), ()),
    ("vim", ("vim licen[sc]e",), ()),
    ("unicode", ("unicode licen[sc]e agreement", "unicode licen[sc]e"), ()),
    ("openrail", ("creativeml open rail m", "open rail licen[sc]e", "openrail m"), ()),
    ("llama", ("llama community licen[sc]e", "llama 2 community licen[sc]e", "llama 3 community licen[sc]e"), ()),
    ("public-domain", ("released into the public domain", "dedicated to the public domain", "public domain"), ()),
    ("all-rights-reserved", ("rights reserved",), ()),
    ("proprietary", ("proprietary and confidential", "confidential and proprietary", "proprietary licen[sc]e"), ()),
)
VERSION = r"( licen[sc]e)?( version)?( v)? "
GRANTS = ("licensed", "released", "distributed", "available", "published", "redistributed", "provided")


@dataclass(frozen=True)
class Rule:
    """``pattern`` over words that are each followed by one space; ``keyword`` is its first word."""

    label: str
    keyword: str
    pattern: str
    confidence: float


def build_rules() -> list[Rule]:
    """All rules, earlier ones with priority: later-version, versioned, identifier, granting, then bare names."""
    tiers: list[list[Rule]] = [[] for _ in range(6)]
    for label, names, versions in FAMILIES:
        for k, name in enumerate(names):
            words = name.replace(" ?", " ").split(" ")
            for version in versions:
                full = f"{label}-{version.replace(' ', '.')}"
                dotted = rf"({version}|v{version})" if not version[0].isalpha() else version
                head = name + VERSION + dotted
                tiers[0].append(Rule(full + "-or-later", words[0], head + "( or)?( at your option)?( any)? later( version)?", 1.0))
                tiers[1].append(Rule(full, words[0], head, 0.95))
            if k == len(names) - 1:
                tiers[2].append(Rule(label, "spdx", "spdx licen[sc]e identifier " + label.replace("-", " "), 1.0))
            plain = len(words) == 1
            tiers[4 + plain].append(Rule(label, words[0], name, 0.5 if plain else 0.8))
        full_names = "|".join(names)
        tiers[3] += [Rule(label, grant, rf"{grant} (under|by)( the)?( terms)?( and conditions)?( of)?( the)? ({full_names})", 0.9) for grant in GRANTS]
    # Within a tier the longer expression goes first: a version 2.1 before a 2, a lesser licence before the one it names.
    ordered = [r for tier in tiers for r in sorted(tier, key=lambda r: -r.pattern.count(" "))]
    return [Rule(r.label, r.keyword, "^" + r.pattern + " ", r.confidence) for r in ordered]


RULES = build_rules()


def _rules_of(word: Column) -> Column:
    """The rules gated by a word, as an array of (rank, label, pattern, confidence)."""
    by: dict[str, list[tuple[int, Rule]]] = {}
    for rank, rule in enumerate(RULES):
        by.setdefault(rule.keyword, []).append((rank, rule))
    rows = {k: [{"rank": rank, "label": r.label, "pattern": r.pattern, "confidence": r.confidence} for rank, r in v] for k, v in sorted(by.items())}
    # A constant: folded into the plan once.
    table = F.from_json(F.lit(json.dumps(rows)), "map<string, array<struct<rank: int, label: string, pattern: string, confidence: double>>>")
    return F.element_at(table, word)


def keywords() -> list[str]:
    return sorted({r.keyword for r in RULES} | {phrase.split(" ")[0] for phrase, _ in BASE})


def detections(window: Column, place: Column, word: Column) -> Column:
    """(first, -end, rank, label, confidence) of all rules that match at one place."""
    matching = F.filter(_rules_of(word), lambda r: F.rlike(window, r["pattern"]))
    return F.transform(matching, lambda r: F.struct(
        place.alias("first"), (-(place + F.regexp_count(F.regexp_substr(window, r["pattern"]), F.lit(" ")))).alias("back"),
        r["rank"].alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence"),
    ))


def suppress(found: Column) -> Column:
    """labels and score of what is left of detections sorted by start, longest first, then rank.

    A container of an interval comes before it in that order, so it is enough to remember intervals still open.
    """
    opened = "array<struct<back: int, rank: int>>"
    start = F.struct(F.expr(f"cast(array() as {opened})").alias("open"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"))

    def step(state, d):
        still = F.filter(state["open"], lambda o: -o["back"] > d["first"])
        inside = F.exists(still, lambda o: (o["back"] <= d["back"]) & (o["rank"] < d["rank"]))
        return F.struct(
            F.array_append(still, F.struct(d["back"].alias("back"), d["rank"].alias("rank"))).alias("open"),
            F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["confidence"])).alias("score"),
        )

    return F.aggregate(found, start, step)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs`` (doc_id, text).

    Words are runs of lower-cased letters, digits and non-ASCII characters. ``labels`` are the distinct labels of base
    phrases and of detections that no earlier rule contains, sorted and comma-joined; ``score`` is the highest
    confidence among the latter. Null and empty texts have no words, no places (null), no labels and score 0. Repeated
    rows are scanned one by one; other columns are ignored; an empty table gives an empty result. Row-wise throughout:
    nothing is shuffled.
    """
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    words = docs.select("doc_id", F.filter(F.split(text, NOT_WORD), lambda w: w != "").alias("words"))
    held = F.arrays_overlap("words", F.array(*map(F.lit, keywords())))
    places = F.when(held, F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"].isin(keywords())))
    anchored = words.withColumn("places", F.coalesce(places, F.expr("cast(array() as array<struct<i: int, w: string>>)")))
    # The words from each place on, each followed by one space.
    windows = anchored.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("places", lambda s: F.struct(
        s["i"].alias("i"), s["w"].alias("w"), F.concat(F.array_join(F.slice(F.col("words"), s["i"] + 1, REACH), " "), F.lit(" ")).alias("window"),
    )).alias("windows"))
    base = F.filter("windows", lambda s: F.exists(F.array(*(F.lit(p + " ") for p, _ in BASE)), lambda p: s["window"].startswith(p)))
    found = F.sort_array(F.flatten(F.transform("windows", lambda s: detections(s["window"], s["i"], s["w"]))))
    resolved = windows.select("doc_id", "n_words", base.alias("base"), found.alias("found")).select(
        "doc_id", "n_words", F.transform("base", lambda s: s["i"]).alias("at"), F.array(*(
            F.when(_holds(phrase), F.lit(label)) for phrase, label in BASE
        )).alias("base_labels"), suppress(F.col("found")).alias("kept"),
    )
    named = F.array_compact("base_labels")
    return resolved.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.col("kept.labels"))), ",").alias("labels"), F.col("kept.score").alias("score"),
    )


def _holds(phrase: str) -> Column:
    return F.exists("base", lambda s: s["window"].startswith(phrase + " "))
