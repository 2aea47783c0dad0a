"""License scans by sentence rules.

Known licence sentences, normalised, have identifiers. A text's sentences, on one line or wrapped over several, are looked up among them by a broadcast hash join, and
the sequence of identifiers is matched against ordered rules: a rule names a licence by the sentences that follow each other.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.llm.tables import NOT_ALNUM, lower_ascii, row_key

#: Sentences of public licences and notices.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do"
        " so, subject to the following conditions:"
    ),
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-condition": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
        " in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission."
    ),
    "bsd-author": (
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written"
        " permission."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-grant-2": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    # Without "This program is free software", which is a part of gpl-grant: no part has two identifiers.
    "gpl2-grant": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl2-only-grant": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free"
        " Software Foundation."
    ),
    "lgpl21-grant": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl3-grant": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl3-grant": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-notice-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-dedication": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to"
        " the public domain worldwide."
    ),
    # Heads of whole texts.
    "apache-date": "Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-name": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-name": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-name": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2-date": "Version 2, June 1991",
    "gpl3-date": "Version 3, 29 June 2007",
    "agpl3-date": "Version 3, 19 November 2007",
    "lgpl21-date": "Version 2.1, February 1999",
    "mpl2-head": "Mozilla Public License Version 2.0",
    "epl2-head": "Eclipse Public License - v 2.0",
    "bsl-head": "Boost Software License - Version 1.0 - August 17th, 2003",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    # An identifier line; marks split it from its value.
    "spdx": "SPDX-License-Identifier",
}

#: Sentences with names in them, as patterns of normalised sentences, and the sentences above that they stand for.
OPEN_SENTENCES = {
    "bsd-names": "neither the names? of .{1,200}? nor the names of (its|their|the|any) contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission",
    "bsd-author": "the names? of .{1,200}? may not be used to endorse or promote products derived from this software without (specific )?prior written permission",
}

#: Lines or sentences over which one with names in it may be wrapped.
OPEN_PIECES = 8
#: SPDX identifiers and what notices call these licences.
NAMES = {
    "MIT": ("MIT License", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License, version 2", "Apache 2.0 License", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Revised BSD License"),
    "GPL-2.0-only": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2", "GPL-2.0"),
    "GPL-3.0-only": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"),
    "ISC": ("ISC License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Unlicense": ("Unlicense",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
#: Identifiers that only identifier lines use.
MORE_IDENTIFIERS = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
#: How notices begin, as a pattern of normalised sentences; all beginnings count as one.
NOTICE = (
    "^(this (project|software|file|work|program|library|code|package|repository) is )?(licensed|released|distributed|made available|available)"
    " under (the terms of )?(the |a |an )?"
)


@dataclass(frozen=True)
class Rule:
    """A licence and the sentences that, in this order, declare it."""

    license: str
    sentences: tuple[str, ...]


RULES = (
    Rule("MIT", ("mit-notice",)), Rule("MIT", ("mit-grant", "mit-condition")),
    Rule("Apache-2.0", ("apache-notice",)), Rule("Apache-2.0", ("apache-grant", "apache-condition")),
    Rule("GPL-3.0-only", ("gpl3-notice",)), Rule("GPL-3.0-or-later", ("gpl-grant", "gpl-warranty")),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-notice",)), Rule("CC-BY-4.0", ("cc-by-notice",)),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-author")),
    Rule("ISC", ("isc-grant",)), Rule("ISC", ("isc-grant-2",)), Rule("MPL-2.0", ("mpl2-notice",)),
    Rule("GPL-2.0-or-later", ("gpl2-grant",)), Rule("GPL-2.0-only", ("gpl2-only-grant",)),
    Rule("LGPL-2.1-or-later", ("lgpl21-grant",)), Rule("LGPL-3.0-or-later", ("lgpl3-grant",)), Rule("AGPL-3.0-or-later", ("agpl3-grant",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-notice",)), Rule("CC-BY-SA-4.0", ("cc-by-sa-notice-2",)), Rule("CC0-1.0", ("cc0-dedication",)),
)

RULES += (
    Rule("Apache-2.0", ("apache-date", "apache-terms")), Rule("GPL-2.0-only", ("gpl-name", "gpl2-date")), Rule("GPL-3.0-only", ("gpl-name", "gpl3-date")),
    Rule("LGPL-2.1-only", ("lgpl-name", "lgpl21-date")), Rule("LGPL-3.0-only", ("lgpl-name", "gpl3-date")), Rule("AGPL-3.0-only", ("agpl-name", "agpl3-date")),
    Rule("MPL-2.0", ("mpl2-head",)), Rule("EPL-2.0", ("epl2-head",)), Rule("BSL-1.0", ("bsl-head",)), Rule("Unlicense", ("unlicense-grant",)),
    *[Rule(name, ("spdx", f"id-{name}")) for name in (*NAMES, *MORE_IDENTIFIERS)],
)
SENTENCES |= {f"id-{name}": name for name in (*NAMES, *MORE_IDENTIFIERS)}


#: A sentence ends at the end of a line, or with a mark before a blank.
ENDS = r"[.!?;:][\x20\x09\x0D]+|\x0A"


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _plain(text: str) -> str:
    return re.sub(NOT_ALNUM, " ", text.translate(_LOWER)).strip()


def _canonical(sentence: str) -> str:
    """A normalised sentence in the form in which it is looked up."""
    return re.sub(NOTICE, "notice ", sentence)


def _add_notices() -> None:
    """Adds the notices of `NAMES`, each a rule of its own, unless a sentence already says the same."""
    global RULES
    known = {_canonical(_plain(text)) for text in SENTENCES.values()}
    for license, names in NAMES.items():
        for k, name in enumerate(names):
            text = f"Licensed under the {name}."
            if _canonical(_plain(text)) not in known:
                known.add(_canonical(_plain(text)))
                SENTENCES[f"notice-{license}-{k}"] = text
                RULES += (Rule(license, (f"notice-{license}-{k}",)),)


_add_notices()


def canonical(sentence):
    """The same for a column."""
    return F.when(sentence.rlike(NOTICE), F.regexp_replace(sentence, NOTICE, "notice ")).otherwise(sentence)


def normalized(text):
    return F.trim(F.regexp_replace(lower_ascii(text), NOT_ALNUM, " "))


def sentence_table(spark: SparkSession, sentences: dict[str, str]) -> DataFrame:
    """`sentence_id, known` of a fixed list. A sentence that marks split, as "WARRANTY; without" does, is known by its parts."""
    rows = spark.createDataFrame(list(sentences.items()), "sentence_id string, text string")
    parts = rows.select("sentence_id", F.posexplode(F.filter(F.transform(F.split("text", ENDS), normalized), lambda s: s != "")))
    return parts.select(F.when(F.col("pos") > 0, F.concat_ws("/", "sentence_id", "pos")).otherwise(F.col("sentence_id")).alias("sentence_id"), canonical(F.col("col")).alias("known"))


def _rule_ids(rule: Rule, sentences: dict[str, str]) -> list[str]:
    ids = []
    for name in rule.sentences:
        parts = [p for p in re.split(ENDS, sentences[name]) if re.search("[0-9A-Za-z\x80-\U0010ffff]", p)]
        ids += [name if k == 0 else f"{name}/{k}" for k in range(len(parts))]
    return ids


def _wrapped(sentences: dict[str, str]):
    """`place, last, sentence` of known sentences that are wrapped over several of `pieces`, and of those with names in them, wrapped or not.

    Comment marks are no words and don't matter.
    """
    parts = {_plain(p) for text in sentences.values() for p in re.split(ENDS, text)} - {""}
    words = [p.split(" ") for p in sorted(parts) if " " in p]
    if not words:
        return F.expr("cast(array() AS array<struct<place:int, last:int, sentence:string>>)")
    known, most = ", ".join(f"'{' '.join(w)}'" for w in words), max(map(len, words))
    # The first of the pieces is one word, or begins with two; few pieces do.
    first = f"^({'|'.join(sorted({' '.join(w[:2]) for w in words}))})( |$)|^({'|'.join(sorted({w[0] for w in words}))})$"
    open_sentences = ", ".join(
        f"struct('^{pattern}$' AS pattern, '{_plain(sentences[name])}' AS sentence)" for name, pattern in OPEN_SENTENCES.items() if name in sentences
    )
    named = f"""flatten(transform(
            filter(CASE WHEN size(pieces) > 0 THEN sequence(1, size(pieces)) ELSE cast(array() AS array<int>) END,
                i -> startswith(pieces[i - 1], 'neither the name') OR startswith(pieces[i - 1], 'the name')),
            i -> flatten(transform(array({open_sentences}), o -> transform(
                slice(filter(sequence(1, least({OPEN_PIECES}, size(pieces) - i + 1)), n -> array_join(slice(pieces, i, n), ' ') RLIKE o.pattern), 1, 1),
                n -> struct(i AS place, i + n - 1 AS last, o.sentence AS sentence))))))""" if open_sentences else "cast(array() AS array<struct<place:int, last:int, sentence:string>>)"
    return F.expr(
        f"""concat({named}, flatten(transform(
            filter(CASE WHEN size(pieces) > 1 THEN sequence(1, size(pieces) - 1) ELSE cast(array() AS array<int>) END, i -> pieces[i - 1] RLIKE '{first}'),
            i -> flatten(transform(
                filter(array({known}), k -> startswith(concat(array_join(slice(pieces, i, {most}), ' '), ' '), concat(k, ' '))),
                k -> transform(
                    filter(sequence(2, greatest(2, least({most}, size(pieces) - i + 1))), n -> array_join(slice(pieces, i, n), ' ') = k),
                    n -> struct(i AS place, i + n - 1 AS last, k AS sentence)))))))"""
    )


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sentences: dict[str, str] | None = None, gap: int = 2, unwrap: bool = False) -> DataFrame:
    """`doc_id, copies, n_sentences, found, licenses` for each distinct `(doc_id, text)`; `copies` counts its rows.

    `found` lists `place, sentence_id, last` of known sentences in order, those inside of longer ones left out; a sentence that is wrapped over
    lines lies on the places up to `last`. Of rules that begin alike, the longest one that fits counts. `licenses` the distinct licences, sorted, of rules whose sentences
    follow each other in `found` with at most `gap` other sentences between two. `unwrap` reads single line ends as
    blanks, for hard-wrapped files. Null, empty and blank texts have no sentences. Nothing but hits is shuffled.
    """
    sentences = SENTENCES if sentences is None else sentences
    known = sentence_table(documents.sparkSession, sentences)  # as many rows as the fixed list has parts
    text = F.regexp_replace("text", r"(?<!\x0A)\x0A(?!\x0A)", " ") if unwrap else F.col("text")
    pieces = F.filter(F.transform(F.split(text, ENDS), normalized), lambda s: s != "")
    rows = documents.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", F.coalesce(pieces, F.expr("cast(array() AS array<string>)")).alias("pieces"))
    rows = rows.withColumn("n_sentences", F.size("pieces")).withColumn(
        "probes",
        F.concat(
            F.expr("array(struct(0 AS place, 0 AS last, '' AS sentence))"),
            F.transform("pieces", lambda p, i: F.struct((i + 1).alias("place"), (i + 1).alias("last"), p.alias("sentence"))),
            _wrapped(sentences),
        ),
    )
    # Place 0 stands for the document itself. The outer form: see `decontaminate.find_spans`.
    probed = rows.select("key_a", "key_b", "doc_id", "n_sentences", F.explode_outer("probes").alias("probe")).select("*", "probe.*")
    hits = probed.withColumn("sentence", canonical(F.col("sentence"))).join(F.broadcast(known), F.col("sentence") == F.col("known"), "left").filter("place = 0 OR sentence_id IS NOT NULL")
    grouped = hits.groupBy("key_a", "key_b").agg(
        F.first("doc_id").alias("doc_id"), F.sum(F.when(F.col("place") == 0, 1)).alias("copies"),
        F.first("n_sentences").cast("long").alias("n_sentences"),
        F.array_sort(F.collect_set(F.when(F.col("place") > 0, F.struct("place", "sentence_id", "last")))).alias("found"),
    )
    inside = "f -> NOT exists(found, g -> g.place <= f.place AND f.last <= g.last AND g.last - g.place > f.last - f.place)"
    grouped = grouped.withColumn("found", F.expr(f"CASE WHEN exists(found, f -> f.last > f.place) THEN filter(found, {inside}) ELSE found END"))

    def steps(ids: list[str]) -> str:
        return " AND ".join(
            [f"get(found, j + {k}).sentence_id = '{name}'" for k, name in enumerate(ids)]
            + [f"get(found, j + {k}).place - get(found, j + {k - 1}).last <= {gap + 1}" for k in range(1, len(ids))]
        )

    matches, lists = [], [_rule_ids(rule, sentences) for rule in rules]
    for rule, ids in zip(rules, lists):
        fits = f"({steps(ids)})" + "".join(
            f" AND NOT coalesce({steps(other)}, false)" for other in lists if len(other) > len(ids) and other[: len(ids)] == ids
        )
        matches.append(
            f"CASE WHEN size(found) >= {len(ids)} AND exists(sequence(0, greatest(0, size(found) - {len(ids)})), j -> {fits})"
            f" THEN '{rule.license}' END"
        )
    licenses = F.array_sort(F.array_distinct(F.array_compact(F.array(*map(F.expr, matches)))))
    return grouped.select("doc_id", "copies", "n_sentences", "found", licenses.alias("licenses"))
