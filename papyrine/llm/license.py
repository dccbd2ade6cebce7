"""Licence scans by sentence rules and ordered licence rules, with DataFrame functions only.

Wrapped lines are joined and a text is cut into sentences; each is normalised
and, if it may speak of licences, mapped to the identifier of the first phrase
that it has, or of all licences that it names, or of the first other rule. The
text's sequence of identifiers is then matched against the licence rules in
order, the more specific first; what a rule matches is taken out of the sequence.
Sentences with a licence word that no rule knows get the identifier ``unknown``;
rules pass over them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from papyrine.llm.text import bind

#: A sentence without any of these, in lower case, is not looked at.
KEYWORDS = ("licen", "copyright", "spdx", "warrant", "redistribut", "permission", "rights reserved", "public domain", "gpl", "creative commons", "required by applicable law", "in no event", "cc by", "cc0", "software is provided", "used to endorse")
#: Java and RE2 read all patterns here alike; these are matched in normalised sentences: lower case, words of a-z, 0-9 and +.
SENTENCE_RULES = (
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-law", "unless required by applicable law or agreed to in writing"),
    ("apache-limits", "see the license for the specific language governing permissions"),
    ("apache2", "apache license,? (version )?2|spdx license identifier apache 2 0|apache 2 0 licen[cs]e"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included"),
    ("isc-grant", "permission to use copy modify and or distribute this software"),
    ("mit", "(the|under|under the terms of the) mit licen[cs]e|^mit licen[cs]e|spdx license identifier mit$"),
    ("bsd-grant", "redistribution and use in source and binary forms"),
    ("bsd-source", "redistributions of source code must retain"),
    ("bsd-binary", "redistributions in binary form must reproduce"),
    ("bsd-endorse", "neither the name of .* may be used to endorse"),
    ("as-is", "software is provided .*as is"),
    ("no-liability", "in no event shall"),
    ("any-later", "or at your option any later version"),
    ("lgpl", "lesser general public licen[cs]e|spdx license identifier lgpl"),
    ("agpl", "affero general public licen[cs]e|spdx license identifier agpl"),
    ("gpl3", "general public licen[cs]e.* (version|v) ?3|gplv3|gpl 3|gpl v3"),
    ("gpl2", "general public licen[cs]e.* (version|v) ?2|gplv2|gpl 2|gpl v2"),
    ("gpl", "general public licen[cs]e|spdx license identifier gpl"),
    ("mpl2", "mozilla public licen[cs]e|spdx license identifier mpl"),
    ("cc-by-nc-sa", "cc by nc sa|attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "cc by nc nd|attribution noncommercial noderivatives"),
    ("cc-by-nc", "cc by nc|attribution noncommercial"),
    ("cc-by-sa", "cc by sa|attribution sharealike"),
    ("cc-by", "cc by|creative commons attribution"),
    ("cc0", "cc0|public domain"),
    ("all-rights", "all rights reserved"),
    ("notice", "^copyright|copyright (c )?(19|20)[0-9][0-9]"),
    ("unknown", "licen[cs]|copyright|redistribut"),
)
#: Licence and sequence of identifiers; in brackets with a question mark where the sentence may be missing.
LICENSE_RULES = (
    ("Apache-2.0", "<apache2>(<apache-comply>)?(<apache-obtain>)?(<apache-law>)?(<apache-limits>)?"),
    ("MIT", "(<mit>)?(<notice>)?<mit-grant><mit-notice>(<as-is>)?(<no-liability>)?"),
    ("MIT", "<mit>"),
    ("ISC", "<isc-grant>(<as-is>)?(<no-liability>)?"),
    ("BSD-3-Clause", "<bsd-grant><bsd-source><bsd-binary><bsd-endorse>(<as-is>)?(<no-liability>)?"),
    ("BSD-2-Clause", "<bsd-grant><bsd-source><bsd-binary>(<as-is>)?(<no-liability>)?"),
    ("GPL-3.0-or-later", "<gpl3><any-later>"),
    ("GPL-3.0-only", "<gpl3>"),
    ("GPL-2.0-or-later", "<gpl2><any-later>"),
    ("GPL-2.0-only", "<gpl2>"),
    ("LGPL", "<lgpl>(<any-later>)?"),
    ("AGPL", "<agpl>(<any-later>)?"),
    ("GPL", "<gpl>(<any-later>)?"),
    ("MPL-2.0", "<mpl2>"),
    ("CC-BY-NC-SA", "<cc-by-nc-sa>"),
    ("CC-BY-NC-ND", "<cc-by-nc-nd>"),
    ("CC-BY-NC", "<cc-by-nc>"),
    ("CC-BY-SA", "<cc-by-sa>"),
    ("CC-BY", "<cc-by>"),
    ("CC0-1.0", "<cc0>"),
    ("Proprietary", "(<notice>)?<all-rights>"),
)
_RULE = dict(SENTENCE_RULES)
#: Texts without any of these, in lower case, are not looked at: the words of KEYWORDS that no line wrap or hyphen cuts.
TEXT_KEYWORDS = ("licen", "copyright", "spdx", "warrant", "redistribut", "permission", "reserved", "domain", "gpl", "creative", "applicable", "no event", "cc0", "cc by", "cc-by", "cc\n", "cc\r", "provided", "endorse")
#: Sentences of licence texts, the first that matches.
PHRASES = (
    *((name, _RULE[name]) for name in ("apache-comply", "apache-obtain", "apache-law", "apache-limits", "mit-grant", "mit-notice", "isc-grant", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "no-liability")),
    ("gpl-more", "(see|received a copy of) the gnu (lesser |affero )?general public licen[cs]e (for more details|along with)"),
)
_SPDX = "spdx license identifier.* "
_GPL = "general public licen[cs]e"
#: What the rules of the plain GPL do not look at.
OTHER_GPL = f"(lesser|library|affero) {_GPL}"
#: Licences that a sentence names: the first of each family. Version rules come before the one for any version.
FAMILIES = (
    (("apache2", f"{_RULE['apache2']}|{_SPDX}apache 2"),),
    (("mit", f"{_RULE['mit']}|{_SPDX}mit( |$)"),),
    (("bsd3", "bsd 3 clause|3 clause bsd"), ("bsd2", "bsd 2 clause|2 clause bsd")),
    (("isc", f"(^| )isc licen[cs]e|{_SPDX}isc( |$)"),),
    (("lgpl", f"(lesser|library) {_GPL}|(^| )lgpl"),),
    (("agpl", f"affero {_GPL}|(^| )agpl"),),
    (
        ("gpl3", f"{_GPL}.* (version |v ?)3|{_GPL} 3|version 3 of the gnu {_GPL}|(^| )gpl ?(version |v ?)?3"),
        ("gpl2", f"{_GPL}.* (version |v ?)2|{_GPL} 2|version 2 of the gnu {_GPL}|(^| )gpl ?(version |v ?)?2"),
        ("gpl", f"{_GPL}|{_SPDX}gpl"),
    ),
    (("mpl2", f"mozilla public licen[cs]e|{_SPDX}mpl"),),
    (*((name, _RULE[name]) for name in ("cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nc", "cc-by-sa")), ("cc-by-nd", "cc by nd|attribution noderivatives"), ("cc-by", _RULE["cc-by"])),
    (("cc0", _RULE["cc0"]),),
)
GPL_FAMILY = FAMILIES[6]
#: Families that a later version may follow, and how a sentence says so.
VERSIONED = ("lgpl", "agpl", "gpl3", "gpl2", "gpl")
LATER = "or (at your option )?(any )?later|gpl ?(version |v ?)?[0-9]( [0-9])?[+]"
#: What a sentence without a phrase or a name may still be, the first that matches.
OTHERS = tuple((name, _RULE[name]) for name in ("any-later", "all-rights", "notice", "unknown"))
#: Licence rules with whole notices: the heads of BSD texts, what follows the notice of the GPL, short names.
_MORE = "(<gpl-more>)*"
NOTICE_RULES = (
    *(
        (name, ("(<bsd3>)?" if name == "BSD-3-Clause" else "(<bsd2>)?") + "(<notice>)?(<all-rights>)?" + rule) if name.startswith("BSD") else (name, "(<isc>)?(<notice>)?" + rule) if name == "ISC" else (name, rule + _MORE if "GPL" in name else rule)
        for name, rule in LICENSE_RULES[:-1]
    ),
    ("BSD-3-Clause", "<bsd3>"),
    ("BSD-2-Clause", "<bsd2>"),
    ("ISC", "<isc>"),
    ("GPL", "<gpl-more>"),
    ("CC-BY-ND", "<cc-by-nd>"),
    LICENSE_RULES[-1],
)
_LINE = r"[ \t]*\r?\n[ \t]*(?:(?:[*#;]+|//+|--)[ \t]+)?"
_GOES_ON = "(?i:the|of|under|or|and|gnu|to|by|in|with|version|general|public|lesser|affero|mozilla|creative|apache|mit|bsd|isc)"
_ANY = r"[^\x20\x09-\x0D]"
#: Ends of lines inside a sentence, what stands for them, and how often they are looked for: the next line goes on in lower case, or this one
#: ends with a comma or a word that needs another, or is as long as wrapped prose and ends without a mark. A line of one
#: character ends one match and begins the next, which takes a second look; long lines are joined two by two, so that six looks join 64 of them.
WRAPS = (
    (rf"([A-Za-z0-9,)\"'/]){_LINE}([a-z(])", r"\1 \2", 2),
    (rf"(,){_LINE}({_ANY})", r"\1 \2", 2),
    (rf"(^{_GOES_ON}|[^A-Za-z0-9_]{_GOES_ON}){_LINE}({_ANY})", r"\1 \2", 2),
    (rf"(^|[\r\n])([^\r\n]{{48,}}[A-Za-z0-9)\"']){_LINE}([A-Za-z\"'(])", r"\1\2 \3", 6),
)
SPDX_COLON = r"(?i)(spdx-license-identifier)[ \t]*:[ \t]*"
SENTENCE_END = r"[.;:!?]+[ \t\r\n]+|[.;:!?]+$|[\r\n]+"


def passing_over(rule: str) -> str:
    """A licence rule that passes over unknown sentences between its own, not before or after them."""
    over, out, begun = "(<unknown>)*", [], False
    for optional, often, needed in re.findall(r"\((<[^>]+>)\)([?*])|(<[^>]+>)", rule):
        if needed:
            out.append(over + needed if begun else needed)
            begun = True
        else:
            out.append(f"({over}{optional}){often}" if begun else f"({optional}{over}){often}")
    return "".join(out)


def _maybe(lowered: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    found = lowered.contains(keywords[0])
    for k in keywords[1:]:
        found = found | lowered.contains(k)
    return found


def _first(sentence: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(sentence.rlike(pattern), name).otherwise(found)
    return found


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's licence sentences, in order."""

    def later(name: Column, sentence: Column) -> Column:
        return F.when(name.isin(*VERSIONED) & sentence.rlike(LATER), "any-later")

    def identify(sentence: Column) -> Column:
        names = [_first(sentence if family is not GPL_FAMILY else F.regexp_replace(sentence, OTHER_GPL, ""), family) for family in FAMILIES]
        named = F.array_compact(F.array(*(x for n, f in zip(names, FAMILIES) for x in ((n, later(n, sentence)) if f[0][0] in VERSIONED else (n,)))))
        one = F.array(F.coalesce(_first(sentence, PHRASES), F.when(F.size(named) == 0, _first(sentence, OTHERS))))
        return F.when(F.get(one, 0).isNotNull(), one).otherwise(named)

    def body(raw: Column) -> Column:
        joined = F.regexp_replace(raw, SPDX_COLON, "$1 ")
        for pattern, by, looks in WRAPS:
            for _ in range(looks):
                joined = F.regexp_replace(joined, pattern, by.replace("\\", "$"))
        lowered = F.lower(joined)
        plain = F.transform(F.split(lowered, SENTENCE_END, -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9+]+", " ")))
        return F.flatten(F.transform(F.filter(plain, lambda s: _maybe(s)), identify))

    return F.when(bind(F.lower(text), lambda x: _maybe(x, TEXT_KEYWORDS)), bind(text, body)).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column) -> Column:
    """Struct ``rest, licenses``: what the licence rules leave of a sequence, and the licences found, in the rules' order."""
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(passing_over(p)).alias("pattern")) for n, p in NOTICE_RULES))
    start = F.struct(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("rest"), F.array().cast("array<string>").alias("licenses"))

    def step(s: Column, rule: Column) -> Column:
        found = F.regexp_like(s["rest"], rule["pattern"])
        return F.struct(
            F.when(found, F.regexp_replace(s["rest"], rule["pattern"], F.lit("<>"))).otherwise(s["rest"]).alias("rest"),
            F.when(found, F.array_union(s["licenses"], F.array(rule["name"]))).otherwise(s["licenses"]).alias("licenses"),
        )

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step)).otherwise(F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("licenses")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, licenses, n_sentences, n_unmatched`` for each row of ``docs``.

    ``sentence_ids`` and ``licenses`` are joined by spaces and are empty where
    there are none; ``n_unmatched`` counts the sentences that no licence rule
    took. Null and empty texts have none; texts of any length are read whole; repeated rows come back as often; other
    columns of ``docs`` play no part; an empty table gives an empty table.
    """
    df = docs.select("doc_id", sentence_ids(F.coalesce(F.col(text), F.lit(""))).alias("ids"))
    df = df.select("doc_id", "ids", match_rules(F.col("ids")).alias("m"))
    left = F.regexp_replace("m.rest", "<>", "")
    return df.select(
        "doc_id",
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join("m.licenses", " ").alias("licenses"),
        F.size("ids").cast("long").alias("n_sentences"),
        (F.length(left) - F.length(F.regexp_replace(left, "<", ""))).cast("long").alias("n_unmatched"),
    )


def scan_sql() -> str:
    """The same as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    has = lambda x, p: f"regexp_matches({x}, {quote(p)})"
    swap = lambda x, p, by: f"regexp_replace({x}, {quote(p)}, {quote(by)}, 'g')"
    maybe = lambda x, keywords: "(" + " OR ".join(f"contains({x}, {quote(k)})" for k in keywords) + ")"
    first = lambda x, rules: "CASE " + " ".join(f"WHEN {has(x, p)} THEN {quote(n)}" for n, p in rules) + " END"
    joined = swap("text", SPDX_COLON, "\\1 ")
    for pattern, by, looks in WRAPS:
        for _ in range(looks):
            joined = swap(joined, pattern, by)
    names = []
    for family in FAMILIES:
        name = first(swap("s", OTHER_GPL, "") if family is GPL_FAMILY else "s", family)
        names.append(name)
        if family[0][0] in VERSIONED:
            names.append(f"CASE WHEN {name} IN ({', '.join(map(quote, VERSIONED))}) AND {has('s', LATER)} THEN 'any-later' END")
    steps = "SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM identified"
    for name, rule in NOTICE_RULES:
        p = passing_over(rule)
        steps = f"SELECT doc_id, ids, {swap('rest', p, '<>')} AS rest, CASE WHEN {has('rest', p)} AND NOT list_contains(found, {quote(name)}) THEN list_append(found, {quote(name)}) ELSE found END AS found FROM ({steps})"
    return f"""
    WITH joined AS (SELECT doc_id, CASE WHEN {maybe("lower(text)", TEXT_KEYWORDS)} THEN lower({joined}) END AS t FROM documents),
    sentences AS (SELECT doc_id, row_number() OVER () AS row_id, list_filter(list_transform(regexp_split_to_array(t, {quote(SENTENCE_END)}), lambda x: trim(regexp_replace(x, '[^a-z0-9+]+', ' ', 'g'))), lambda x: {maybe("x", KEYWORDS)}) AS l FROM joined),
    parts AS (SELECT row_id, s, place FROM (SELECT row_id, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM sentences)),
    named AS (SELECT row_id, place, s, list_filter([{", ".join(names)}], lambda x: x IS NOT NULL) AS own, {first("s", PHRASES)} AS phrase FROM parts),
    one AS (SELECT row_id, place, CASE WHEN phrase IS NOT NULL THEN [phrase] WHEN len(own) > 0 THEN own ELSE list_filter([{first("s", OTHERS)}], lambda x: x IS NOT NULL) END AS own FROM named),
    gathered AS (SELECT row_id, flatten(list(own ORDER BY place)) AS ids FROM one GROUP BY row_id),
    identified AS (SELECT s.doc_id, coalesce(g.ids, CAST([] AS VARCHAR[])) AS ids FROM sentences s LEFT JOIN gathered g ON g.row_id = s.row_id)
    SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(array_to_string(found, ' '), '') AS licenses,
      CAST(len(ids) AS BIGINT) AS n_sentences,
      CAST(length(replace(rest, '<>', '')) - length(replace(replace(rest, '<>', ''), '<', '')) AS BIGINT) AS n_unmatched
    FROM ({steps})"""
