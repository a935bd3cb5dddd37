"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into pieces (line ends, and full stops before white space), each
normalised (lower case; runs of other characters than letters, digits and inner
dots are one space).  A known licence sentence is a whole piece or several that
follow each other, as notices are wrapped over lines; a line without letters and
digits (blank, or a bare comment mark) ends it.  Where a shorter and a longer one
begin, the longer counts, and a piece belongs to one sentence.  The sequence of
their identifiers, in text order, is matched against ordered licence rules, each a
sequence of identifiers: a rule takes all its occurrences before the next rule is
tried, so full notices win over single lines.  Identifiers that no rule takes are
counted as unmatched.

Everything happens within a row; there is no shuffle and no group.  Only texts
that hold a trigger (one of which every known sentence holds) are cut.  Defined
results: null and empty texts and texts without licence sentences give no licences
and zero counts; repeated sentences count each time; other columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of known licence sentences and their normalised texts.
SENTENCES = {
    "apache-line": "licensed under the apache license version 2.0",
    "apache-the-license": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www.apache.org licenses license 2.0",
    "mit-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl2-line": "this work is licensed under the gnu general public license version 2",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-line": "licensed under the gnu lesser general public license version 3",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-line": "released under the bsd license",
    "mpl-line": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc0": "released under the cc0 license",
    "isc-line": "released under the isc license",
}
# Ordered licence rules (licence, sequence of sentence identifiers).
RULES = (
    ("Apache-2.0", ("apache-the-license", "apache-comply", "apache-obtain", "apache-url")),
    ("Apache-2.0", ("apache-the-license", "apache-comply")),
    ("MIT", ("mit-title", "mit-notice", "as-is")),
    ("MIT", ("mit-notice", "as-is")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-no-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("Apache-2.0", ("apache-the-license",)),
    ("Apache-2.0", ("apache-line",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("GPL-2.0-only", ("gpl2-line",)),
    ("LGPL-3.0-only", ("lgpl-line",)),
    ("BSD", ("bsd-redistribution",)),
    ("BSD", ("bsd-line",)),
    ("MPL-2.0", ("mpl-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc-line",)),
)
TRIGGERS = ("licen", "copies", "warrant", "redistribut", "compliance")
STOP = r"\.[ \t\r\n\f]+"  # a full stop before white space ends a sentence


def check_tables(sentences=None, rules=None, triggers=TRIGGERS) -> None:
    """Every sentence holds a trigger and every rule names known sentences."""
    for s in (sentences or SENTENCES).values():
        if not any(t in s for t in triggers):
            raise ValueError(f"no trigger in: {s}")
    for _, seq in rules or RULES:
        for i in seq:
            if i not in (sentences or SENTENCES):
                raise ValueError(f"unknown sentence: {i}")


def normalised(text: Column) -> Column:
    """The pieces of a text, one per line, without marks at their beginnings."""
    lines = F.regexp_replace(F.lower(text), r"\n[^a-z0-9\n]+", "\n")
    pieces = F.regexp_replace(F.regexp_replace(lines, STOP, ".\n"), r"[^a-z0-9.\n]+", " ")
    return F.regexp_replace(pieces, r"(?:^| *\n)[ .]*", "\n")


def sentence_ids(text: Column, sentences=None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    sentences = sentences or SENTENCES
    known = F.create_map([F.lit(x) for i, s in sentences.items() for x in (s, i)])
    trigger = "(?i)" + "|".join(TRIGGERS)
    # a space of a sentence may be a line end; longer sentences are tried first
    one_of = "|".join(re.escape(s).replace("\\ ", "[ \n]") for s in sorted(sentences.values(), key=len, reverse=True))
    found = F.regexp_extract_all(normalised(text), F.lit(rf"(?<=\n)({one_of})(?=[ .]*(?:\n|\z))"), F.lit(1))
    ids = F.transform(found, lambda s: known[F.translate(s, "\n", " ")])
    return F.when(text.rlike(trigger), ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=None, rules=None) -> DataFrame:
    """Per row: id, n_sentences (known ones), sentences (identifiers in order, joined by
    a space), licenses (distinct, in rule order, joined by a comma), n_matched
    (occurrences of rules), n_unmatched (identifiers that no rule took)."""
    check_tables(sentences, rules)
    rules = rules or RULES
    out = docs.select(F.col(id_col).alias("id"), sentence_ids(F.col(text_col), sentences).alias("ids"))
    # "<a><b>" so that a rule's sequence is a substring of whole identifiers
    seq = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    out = out.select("id", F.size("ids").alias("n_sentences"), F.concat_ws(" ", "ids").alias("sentences"), seq.alias("seq0"))
    for n, (_, ids) in enumerate(rules):
        own = "".join(f"<{i}>" for i in ids)
        rest = F.replace(F.col(f"seq{n}"), F.lit(own), F.lit("|"))
        out = out.withColumn(f"seq{n + 1}", rest).withColumn(
            f"hit{n}", ((F.length(f"seq{n}") - F.length(rest)) / (len(own) - 1)).cast("int"))
    names = F.array_distinct(F.filter(F.array([F.when(F.col(f"hit{n}") > 0, F.lit(name)) for n, (name, _) in enumerate(rules)]), lambda x: x.isNotNull()))
    matched = sum((F.col(f"hit{n}") for n in range(len(rules))), F.lit(0))
    left = F.col(f"seq{len(rules)}")
    return out.select(F.col("id").alias(id_col), "n_sentences", "sentences", F.concat_ws(",", names).alias("licenses"), matched.alias("n_matched"),
                      (F.length(left) - F.length(F.replace(left, F.lit("<"), F.lit("")))).alias("n_unmatched"))


def oracle_sql() -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(s)}: {quote(i)}" for i, s in SENTENCES.items()) + "}"
    trigger = "(?i)" + "|".join(TRIGGERS)
    parts = rf"list_filter(string_split(regexp_replace(text, '{STOP}', '.' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '{trigger}'))"
    norm = "regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    base = (f"SELECT doc_id, CASE WHEN regexp_matches(text, '{trigger}') THEN "
            f"list_filter(list_transform({parts}, lambda s: ({known})[{norm}]), lambda i: i IS NOT NULL) "
            f"ELSE CAST([] AS VARCHAR[]) END AS ids FROM documents")
    steps = [f"s AS ({base})", "r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS seq FROM s)"]
    hits = []
    for n, (_, ids) in enumerate(RULES):
        own = quote("".join(f"<{i}>" for i in ids))
        more = "".join(f", {h}" for h in hits)
        steps.append(f"r{n + 1} AS (SELECT doc_id, ids, replace(seq, {own}, '|') AS seq{more}, "
                     f"(length(seq) - length(replace(seq, {own}, '|'))) // (length({own}) - 1) AS hit{n} FROM r{n})")
        hits.append(f"hit{n}")
    names = []
    for n, (name, _) in enumerate(RULES):
        earlier = [m for m in range(n) if RULES[m][0] == name]
        names.append(f"CASE WHEN hit{n} > 0" + "".join(f" AND hit{m} = 0" for m in earlier) + f" THEN {quote(name)} END")
    return ("WITH " + ", ".join(steps) + " SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_sentences, array_to_string(ids, ' ') AS sentences, "
            f"array_to_string(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL), ',') AS licenses, "
            f"CAST({' + '.join(hits)} AS INTEGER) AS n_matched, CAST(length(seq) - length(replace(seq, '<', '')) AS INTEGER) AS n_unmatched FROM r{len(RULES)}")
