"""Licence notices by ordered signature rules.

Texts are compared as words: runs of letters, digits and characters beyond ASCII
in lower case, joined by single spaces.  A rule is a pattern over such words
with a keyword, a priority and a weight.  Only rules whose keyword a text
contains are run on it.  Overlapping detections are then resolved: one whose
words lie inside those of another goes if the other's priority is higher, or
equal and the other is longer or listed earlier.  Base phrases are counted at
all places and keep their labels.

Everything happens within the row: there is no shuffle.  DataFrame functions
only.  Nulls count as empty texts, which have no words and the score 0.  Repeated
rows give repeated rows; empty tables give none.  All columns of the table but
``text`` stay; added columns must not be among them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import text_or_empty

#: Phrases that are counted at all places, with their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Hand-written signatures: label, keyword that must occur, pattern of the licence's name over words.
NAMES = [
    ("0bsd", "0bsd", r"0bsd"),
    ("afl", "academic free", r"academic free license(?: v(?:ersion)?)?(?: ?\d)*"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)?(?: v?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agpl(?: ?v?3)?(?: 0)?(?: only| or later)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license(?: version)? v?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license(?: version)? v?2(?: 0)?"),
    ("apache-2.0", "apache 2", r"apache 2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("apsl", "apple public", r"apple public source license"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)?(?: 2(?: 0)?)?"),
    ("beerware", "beerware", r"beerware"),
    ("beerware", "beer ware", r"beer ware"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified) bsd"),
    ("bsd-2-clause", "bsd 2", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|modified|revised) bsd"),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|four clause|original) bsd"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("boost-1.0", "boost", r"boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", r"cc by(?: \d(?: \d)?)?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: \d(?: \d)?)?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: \d(?: \d)?)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: \d(?: \d)?)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: \d(?: \d)?)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: \d(?: \d)?)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: \d(?: \d)?)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: \d(?: \d)?)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: \d(?: \d)?)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: \d(?: \d)?)?"),
    ("creative-commons", "creative commons", r"creative commons"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl-1.0", "common development", r"common development and distribution license"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: 2(?: \d)?)?"),
    ("cpal-1.0", "common public attribution", r"common public attribution license"),
    ("cpl-1.0", "common public", r"common public license(?: version)?(?: 1 0)?"),
    ("ecl-2.0", "educational community", r"educational community license"),
    ("efl", "eiffel forum", r"eiffel forum license"),
    ("epl-1.0", "eclipse public", r"eclipse public license(?: version)? v?1 0"),
    ("epl-2.0", "eclipse public", r"eclipse public license(?: version)?(?: v?2(?: 0)?)?"),
    ("eupl-1.2", "eupl", r"eupl(?: v?1 [012])?"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e"),
    ("fdl", "free documentation", r"(?:gnu )?free documentation license(?: version)?(?: \d(?: \d)?)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: version| v)? ?v?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("isc", "isc", r"isc"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license(?: version)? v?2(?: 1)?"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license(?: version)? v?3(?: 0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: \d)?)?(?: only| or later)?"),
    ("lppl", "latex project", r"latex project public license"),
    ("mit", "mit", r"mit(?: x11| expat)?"),
    ("mit", "expat", r"expat"),
    ("mpl-1.1", "mozilla public", r"mozilla public license(?: version)? 1 [01]"),
    ("mpl-2.0", "mozilla public", r"mozilla public license(?: version)?(?: v?2(?: 0)?)?"),
    ("mpl-2.0", "mpl", r"mpl(?: ?v?2(?: 0)?)?"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("ncsa", "illinois", r"university of illinois ncsa(?: open source)?"),
    ("odbl-1.0", "open database", r"open database license(?: version)?(?: v?1 0)?"),
    ("odc-by", "open data commons", r"open data commons attribution license"),
    ("pddl", "public domain dedication", r"public domain dedication and license"),
    ("ogl", "open government", r"open government licen[cs]e(?: v?\d(?: \d)?)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("openssl", "openssl", r"openssl"),
    ("osl-3.0", "open software", r"open software license(?: version)?(?: v?3 0)?"),
    ("php-3.01", "php", r"php"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf-2.0", "python software", r"python software foundation"),
    ("qpl", "q public", r"q public license"),
    ("sleepycat", "sleepycat", r"sleepycat"),
    ("sspl-1.0", "server side public", r"server side public license"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl-1.0", "universal permissive", r"universal permissive license"),
    ("vim", "vim", r"vim"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice)?"),
    ("wtfpl", "wtfpl", r"wtfpl(?: 2)?"),
    ("x11", "x11", r"x11"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("zpl", "zope public", r"zope public license"),
]

#: Ways to mention a licence around its name: pattern, priority and weight.
FORMS = [
    (r"spdx license identifier {name}", 5, 0.99),
    (r"(?:is |are )?(?:dual |re)?(?:licen[cs]ed|released|distributed|published|available|provided|made available|covered|governed)"
     r"(?: by| to you)? under(?: the)?(?: terms(?: and conditions)? of(?: the)?)?(?: an?)? {name}(?: licen[cs]e)?", 4, 0.95),
    (r"(?:licen[cs]e|licen[cs]ed|licencia|lizenz)(?: is| type)?(?: the)? {name}", 3, 0.8),
    (r"{name} (?:(?:open source|free|public) )?licen[cs]e", 3, 0.85),
]

#: Signatures without a licence's name: label, keyword, pattern, priority, weight.
NOTICES = [
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?(?: by)?", 2, 0.6),
    ("reserved", "rights reserved", r"(?:all|some) rights reserved", 2, 0.7),
    ("no-rights-reserved", "no rights reserved", r"no rights reserved", 3, 0.7),
    ("public-domain", "public domain", r"(?:is |are )?(?:in|released into|dedicated to|placed in) the public domain", 3, 0.8),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee", 4, 0.95),
    ("warranty-disclaimer", "without warranty", r"without warranty of any kind", 2, 0.5),
    ("warranty-disclaimer", "as is", r"provided as is", 1, 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential", 3, 0.8),
    ("proprietary", "written permission", r"without(?: the)?(?: prior)?(?: express)? written permission", 3, 0.6),
    ("copyleft", "copyleft", r"copyleft", 1, 0.4),
]

#: names that are words of their own elsewhere and need one of the forms
COMMON_WORDS = {"mit", "isc", "vim", "php", "x11", "w3c", "expat", "openssl", "postgresql", "zlib", "bsd", "sleepycat", "python software"}

SUMMARY = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
TIERS = 6
PLACE = "struct<first:int,last:int>"
DETECTION = "struct<first:int,reach:int,order:int,label:string,last:int,weight:double,base:boolean>"
RULE = "array<struct<label:string,keyword:string,regex:string,priority:int,weight:double,base:boolean>>"


def rules() -> list[dict]:
    """All signatures in order: base phrases, names in every form, bare names, notices."""
    out = [dict(label=a, keyword=p, regex=p, priority=1, weight=0.7, base=True) for a, p in BASE]
    for label, keyword, name in NAMES:
        out += [dict(label=label, keyword=keyword, regex=f.format(name=f"(?:{name})"), priority=p, weight=w, base=False) for f, p, w in FORMS]
        if keyword not in COMMON_WORDS:
            out.append(dict(label=label, keyword=keyword, regex=name, priority=2, weight=0.5, base=False))
    out += [dict(label=a, keyword=k, regex=r, priority=p, weight=w, base=False) for a, k, r, p, w in NOTICES]
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def words_of(text: Column) -> Column:
    """The words of a text, each with a space before it, and one space at the end."""
    joined = F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.btrim(joined), F.lit(" "))


#: steps of a fold that collect into one array, so that no long array grows step by step
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(steps: Column, state: Column, move, kind: str) -> Column:
    """What ``move(state, step)`` -> (state, list of rows of type ``kind``) collects over all steps, in blocks of ``BLOCK``."""
    none = F.from_json(F.lit("[]"), f"array<{kind}>")

    def step(acc, x):
        after, rows = move(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], rows).alias("out"))

    def block(acc, b):
        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return _bound(F.aggregate(b, start, step), lambda end: F.struct(
            end["state"].alias("state"), F.concat(acc["out"], F.array(end["out"])).alias("out")))

    def run(all_steps):
        firsts = F.filter(F.sequence(F.lit(1), F.size(all_steps) + 1, F.lit(BLOCK)), lambda i: i <= F.size(all_steps))
        blocks = F.transform(firsts, lambda i: F.slice(all_steps, i, BLOCK))
        start = F.struct(state.alias("state"), F.from_json(F.lit("[]"), f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"]))

    return _bound(steps, run)


def _places(norm: Column, rule: Column) -> Column:
    """first and last word (exclusive) of each match of a rule's pattern between word borders."""
    regex = F.concat(F.lit(" (?:"), rule["regex"], F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, regex, F.lit(0))

    def places(found):
        between = F.slice(F.split(norm, regex), 1, F.size(found))
        steps = F.zip_with(between, found, lambda b, f: F.struct(_spaces(b).alias("skip"), _spaces(f).alias("words")))

        def move(at, x):
            first = at + x["skip"]
            last = first + x["words"]
            return last, F.array(F.struct(first.alias("first"), last.alias("last")))

        return F.when(F.size(found) > 0, _folded(steps, F.lit(0), move, PLACE)).otherwise(F.from_json(F.lit("[]"), f"array<{PLACE}>"))

    return _bound(found, places)


def _resolved(found: Column) -> Column:
    """Detections that no other one contains with as high a priority; ``found`` is sorted by first word, longest and highest first."""

    def move(ends, d):
        p = -d["order"]
        inside = F.array_max(F.slice(ends, p, TIERS)) >= d["last"]
        seen = F.transform(ends, lambda e, i: F.when(i + 1 == p, F.greatest(e, d["last"])).otherwise(e))
        return seen, F.when(inside, F.from_json(F.lit("[]"), f"array<{DETECTION}>")).otherwise(F.array(d))

    start = F.transform(F.sequence(F.lit(1), F.lit(TIERS)), lambda _: F.lit(-1))
    return F.when(F.size(found) > 0, _folded(found, start, move, DETECTION)).otherwise(found)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``detections`` (after resolving), ``n_words`` and the summary columns.

    n_base counts the places of base phrases, first_word and last_word are their
    smallest and largest start (words from 0).  score is 1 minus the product of
    1 - weight over the detections left.
    """
    signatures = rules()
    keywords = sorted({r["keyword"] for r in signatures}, key=len)
    groups = [{"keyword": k, "rules": [r for r in signatures if r["keyword"] == k]} for k in keywords]
    every = F.from_json(F.lit(json.dumps(groups)), f"array<struct<keyword:string,rules:{RULE}>>")
    gates = [k for i, k in enumerate(keywords) if not any(x in k for x in keywords[:i])]
    keep = [c for c in docs.columns if c != "text"]
    norm = docs.select(*[F.col(f"`{c}`") for c in keep], words_of(text_or_empty()).alias("_norm"))
    any_gate = F.col("_norm").contains(gates[0])
    for k in gates[1:]:
        any_gate = any_gate | F.col("_norm").contains(k)

    # every keyword is looked for once, then its rules are run
    named = F.when(any_gate, F.filter(every, lambda g: F.contains(F.col("_norm"), g["keyword"])))
    gated = F.flatten(F.transform(named, lambda g: g["rules"]))
    hits = norm.withColumn("_rules", F.coalesce(gated, F.from_json(F.lit("[]"), RULE)))

    def detections(rule):
        return F.transform(_places(F.col("_norm"), rule), lambda x: F.struct(
            x["first"].alias("first"), (-x["last"]).alias("reach"), (-rule["priority"]).alias("order"),
            rule["label"].alias("label"), x["last"].alias("last"), rule["weight"].alias("weight"), rule["base"].alias("base")))

    found = hits.withColumn("_found", F.array_sort(F.flatten(F.transform("_rules", detections))))
    found = found.withColumn("detections", _resolved(F.col("_found"))).withColumn("_base", F.filter("_found", lambda d: d["base"]))
    n = _spaces(F.col("_norm")) - 1
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))))
    miss = F.aggregate("detections", F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    return found.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(F.col("_norm") == "  ", F.lit(0)).otherwise(n).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["first"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - miss).alias("score"),
        "detections",
    )
