"""License detection by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over a text's words (lower case, one space between), with a keyword, a priority and a label.
A text is normalised and scanned only if a cheap pattern finds any keyword in it; within it a rule runs only if its keyword is
there. Each detection is an interval of words. A detection that lies within one of a better priority, or within a longer one
of the same priority, is suppressed: "licensed under the gnu general public license version 3" is one detection, not four.

The rules are a constant array that the scan runs over row by row: no join, no shuffle, no state beyond a row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import carried, unpacked


class Rule(NamedTuple):
    label: str
    pattern: str  # over words: lower case, single spaces; it matches whole words
    keyword: str  # a word's start that every match holds
    cue: str  # another one, of the words around a name; empty if there is none
    priority: int  # 1 is best


#: Labels and phrases that are always looked for.
BASE = [("cc-by", "cc by", "cc"), ("gpl", "general public license", "general"), ("reserved", "all rights reserved", "reserved")]

#: Licenses by label, their names as words, and a word that every name holds.
NAMES = [
    ("apache-2.0", "apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?", "apache"),
    ("apache-1.1", "apache(?: software)? licen[sc]e(?: version)? 1 1", "apache"),
    ("apache", "apache(?: software)? licen[sc]e", "apache"),
    ("mit", "mit licen[sc]e", "mit"),
    ("mit", "expat licen[sc]e", "expat"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "attribution"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-2-clause", "freebsd(?: licen[sc]e)?", "freebsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd", "bsd(?: style)? licen[sc]e", "bsd"),
    ("isc", "isc licen[sc]e", "isc"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("gpl-1.0", "(?:gnu )?general public licen[sc]e(?: gpl)?(?: version| v)? 1(?: 0)?", "general"),
    ("gpl-2.0", "(?:gnu )?general public licen[sc]e(?: gpl)?(?: version| v)? 2(?: 0)?", "general"),
    ("gpl-3.0", "(?:gnu )?general public licen[sc]e(?: gpl)?(?: version| v)? 3(?: 0)?", "general"),
    ("gpl", "gnu (?:general public licen[sc]e|gpl)", "gnu"),
    ("gpl-2.0", "gpl ?v?2(?: 0)?", "gpl"),
    ("gpl-3.0", "gpl ?v?3(?: 0)?", "gpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version| v)? 2(?: [01])?", "general"),
    ("lgpl-3.0", "(?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?", "lesser"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "general"),
    ("agpl-3.0", "(?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)?", "affero"),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "affero"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e(?: version)?(?: 1(?: [0-3])?)?", "documentation"),
    ("mpl-1.1", "mozilla public licen[sc]e(?: version| v)? 1(?: [01])?", "mozilla"),
    ("mpl-2.0", "mozilla public licen[sc]e(?: version| v)? 2(?: 0)?", "mozilla"),
    ("mpl", "mozilla public licen[sc]e", "mozilla"),
    ("epl-1.0", "eclipse public licen[sc]e(?: version| v)? 1(?: 0)?", "eclipse"),
    ("epl-2.0", "eclipse public licen[sc]e(?: version| v)? 2(?: 0)?", "eclipse"),
    ("epl", "eclipse public licen[sc]e", "eclipse"),
    ("cddl", "common development and distribution licen[sc]e(?: version)?(?: 1(?: [01])?)?", "distribution"),
    ("cpl", "common public licen[sc]e(?: version)?(?: 1(?: 0)?)?", "common"),
    ("eupl", "european union public licen[sc]e(?: version)?(?: 1(?: [0-2])?)?", "european"),
    ("artistic-2.0", "artistic licen[sc]e(?: version)? 2(?: 0)?", "artistic"),
    ("artistic", "artistic licen[sc]e", "artistic"),
    ("bsl-1.0", "boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?", "boost"),
    ("busl", "business source licen[sc]e(?: version)?(?: 1(?: 1)?)?", "business"),
    ("ofl-1.1", "(?:sil )?open font licen[sc]e(?: version)?(?: 1(?: [01])?)?", "font"),
    ("odbl", "open data(?:base)? (?:commons )?(?:open database )?licen[sc]e", "open"),
    ("unlicense", "the unlicen[sc]e", "unlicen"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "fuck"),
    ("python", "python(?: software foundation)? licen[sc]e(?: version)?(?: 2(?: 0)?)?", "python"),
    ("php", "php licen[sc]e(?: version)?(?: 3(?: 0[01]?)?)?", "php"),
    ("ruby", "ruby licen[sc]e", "ruby"),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft"),
    ("cecill", "cecill(?: [abc])?(?: licen[sc]e)?", "cecill"),
    ("openssl", "openssl licen[sc]e", "openssl"),
    ("postgresql", "postgresql licen[sc]e", "postgresql"),
    ("w3c", "w3c software(?: notice and)? licen[sc]e", "w3c"),
    ("sspl", "server side public licen[sc]e(?: version| v)?(?: 1)?", "server"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("cc0", "cc zero(?: 1 0)?(?: universal)?", "cc zero"),
    ("cc0", "creative commons zero(?: 1 0)?(?: universal)?", "creative commons zero"),
    *[
        (label, f"{name}(?: licen[sc]e)?(?: (?:version )?[1-4] [0-5])?(?: (?:international|unported|generic|licen[sc]e))*", keyword)
        for label, short, long in [
            ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
            ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
            ("cc-by-nc", "by nc", "attribution non ?commercial"),
            ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
            ("cc-by-sa", "by sa", "attribution share ?alike"),
            ("cc-by", "by", "attribution"),
        ]
        for name, keyword in [(f"cc {short}", f"cc {short} "), (f"creative commons {long}", "creative commons attribution")]
    ],
    ("cc", "creative commons(?: public)? licen[sc]e", "commons"),
    ("public-domain", "(?:in|into|to) the public domain", "domain"),
    ("proprietary", "(?:proprietary|commercial) licen[sc]e", "licen"),
]

#: What stands around a name in a grant, from the firmest to the weakest: a word of it, and the priority of the whole.
FORMS = [
    ("(?:is |are )?(?:dual )?licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{}", "under", 1),
    ("(?:is |are )?(?:released|published|distributed|available|provided|redistributed|shared) under (?:the )?(?:terms of (?:the )?)?{}", "under", 1),
    ("(?:subject|according) to (?:the )?(?:terms of (?:the )?)?{}", "to", 1),
    ("(?:governed|covered) by (?:the )?(?:terms of (?:the )?)?{}", "by", 1),
    ("spdx licen[sc]e identifier {}", "spdx", 1),
    ("see (?:the )?(?:full )?{}", "see", 2),
    ("{}", "", 3),
]

#: Phrases that tell of rights or grants without a license's name.
PHRASES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution", 2),
    ("boost", "permission is hereby granted free of charge to any person or organization", "hereby", 2),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu", "gnu", 2),
    ("as-is", "provided as is without warranty of any kind", "warranty", 4),
    ("no-warranty", "without even the implied warranty", "warranty", 4),
    ("reserved", "(?:all|some) rights (?:are )?reserved", "reserved", 3),
    ("reserved", "alle rechte vorbehalten", "vorbehalten", 3),
    ("reserved", "tous droits r(?:é|e)serv(?:é|e)s", "tous", 3),
    ("reserved", "todos los derechos reservados", "derechos", 3),
    ("copyright", "copyright(?: c| ©)?(?: by)?(?: [12][0-9]{3})+", "copyright", 3),
    ("no-copy", "(?:do not|may not be) (?:copy|copied|reproduced?|redistributed?)", "not", 4),
    ("no-commercial", "(?:for )?non ?commercial (?:use|purposes) only", "non", 4),
    ("permission", "(?:reprinted|reproduced|used) (?:with|by) permission", "permission", 4),
    ("licensed", "licen[sc]ed under", "licen", 5),
]


def signature_rules() -> list[Rule]:
    """Every form around every name, then the phrases, in order of priority: some hundreds of rules."""
    made = [Rule(label, form.format(f"(?:{name})"), keyword, cue, priority) for form, cue, priority in FORMS for label, name, keyword in NAMES]
    made += [Rule(label, pattern, keyword, "", priority) for label, pattern, keyword, priority in PHRASES]
    return sorted(made, key=lambda r: r.priority)


#: Every match of a base phrase or a rule holds one of these within a word, in lower case.
GATE = ["licen", "right", "rechte", "droits", "derechos", "cc", "bsd", "gpl", "creative", "attribution", "cecill", "domain", "permission", "redistribut", "warranty", "copied", "copy", "reproduc", "commercial"]

#: Confidence that a detection of a priority is a license notice.
CONFIDENCE = {1: 0.98, 2: 0.95, 3: 0.8, 4: 0.5, 5: 0.4}
#: What ends a word: all ASCII but digits and letters.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What no word holds.
_MARK = "\x01"
_PLACES = "array<struct<first:int,after:int,priority:int,label:string>>"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_line(text: Column) -> Column:
    """The text's words in lower case (A-Z only), each after a space, between a line feed and a closing space."""
    return F.concat(F.lit("\n "), F.translate(F.trim(F.regexp_replace(text, _BREAK, " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^ ]+", ""))


def _places(line: Column, pattern: Column, label: Column, priority: Column) -> Column:
    """The places of a pattern in a line of words, from left to right: first word, word after the last, priority, label.

    The first word of each match gets a mark that no word holds; the marked words' numbers are the matches' places. All steps
    are linear in the line's length.
    """
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    marked = F.split(F.regexp_replace(line, F.concat(F.lit(" ((?:"), pattern, F.lit(")(?= ))")), F.lit(f" {_MARK}$1")), " ")
    # the line begins with a line feed and a space: its first word has number 1 after the split
    numbers = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1)), lambda i: i.isNotNull())
    hits = F.call_function("regexp_extract_all", line, whole, F.lit(0))
    return F.zip_with(numbers, hits, lambda i, hit: F.struct(i.alias("first"), (i + _spaces(hit)).alias("after"), priority.alias("priority"), label.alias("label"))).cast(_PLACES)


def _rule_array(rules: Sequence[Rule]) -> Column:
    """The rules as one constant: Spark folds it once, before the scan."""
    return F.from_json(F.lit(json.dumps([r._asdict() for r in rules])), "array<struct<label:string,pattern:string,keyword:string,cue:string,priority:int>>")


def scan_licenses(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, plus what the scan found.

    ``n_words``; ``base``: every place of the base phrases; ``found``: the rules' detections that remain, each with its first
    word, the word after its last, priority and label, in text order. Null texts count as empty and give no detections. Rows
    are independent, so repeated rows, null ids and an empty table need no care; columns of ``docs`` with the new names are
    replaced.
    """
    rules = signature_rules() if rules is None else list(rules)
    new = ("n_words", "base", "found")
    kept = [c for c in docs.columns if c != text and c not in new]
    none = F.array().cast(_PLACES)
    source = docs.select(carried(kept).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    counted = source.withColumn("n_words", F.regexp_count("text", F.lit(_WORD)).cast("bigint"))
    folded = counted.withColumn("low", F.lower("text"))
    gate = reduce(or_, [F.contains(F.col("low"), F.lit(k)) for k in GATE])
    lined = folded.withColumn("line", F.when(gate, words_line(F.col("text")))).drop("text", "low")
    line = F.col("line")
    base = F.concat(*[F.when(F.contains(line, F.lit(f" {phrase} ")), _places(line, F.lit(phrase), F.lit(label), F.lit(0))).otherwise(none) for label, phrase, _ in BASE])
    every = F.flatten(F.transform(_rule_array(rules), lambda r: F.when(F.contains(line, F.concat(F.lit(" "), r["keyword"])) & F.contains(line, F.concat(F.lit(" "), r["cue"])), _places(line, r["pattern"], r["label"], r["priority"])).otherwise(none)))
    placed = lined.select("row", "n_words", F.when(line.isNotNull(), base).otherwise(none).alias("base"), F.when(line.isNotNull(), F.array_sort(F.array_distinct(every))).otherwise(none).alias("every"))

    def covered(m: Column) -> Column:
        def by(x: Column) -> Column:
            inside = (x["first"] <= m["first"]) & (x["after"] >= m["after"])
            longer = (x["after"] - x["first"]) > (m["after"] - m["first"])
            return inside & ((x["priority"] < m["priority"]) | ((x["priority"] == m["priority"]) & longer))

        return F.exists(F.col("every"), by)

    out = placed.withColumn("found", F.filter("every", lambda m: ~covered(m)))
    return out.select(*unpacked("row", kept), *new)


def summarize(scanned: DataFrame) -> DataFrame:
    """A scan's rows with counts, places and labels in place of the detections, and a score from 0 to 1."""
    base, found = F.col("base"), F.col("found")
    named = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"])))
    starts = F.transform(base, lambda m: m["first"].cast("bigint"))
    sure = F.transform(found, lambda m: F.lit(1.0) - F.element_at(F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)]), m["priority"]))
    doubt = F.aggregate(sure, F.lit(1.0), lambda a, x: a * x) * F.when(F.size(base) > 0, F.lit(0.2)).otherwise(F.lit(1.0))
    return scanned.select(
        *[F.col(f"`{c}`") for c in scanned.columns if c not in ("base", "found")],
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(named(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named(base), named(found))), ",").alias("labels"),
        F.round(F.lit(1.0) - doubt, 9).alias("score"),
    )
