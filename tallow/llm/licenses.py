"""License scans by ordered signature rules (native DataFrame functions only).

A text is lower-cased and cut into words. Phrases are looked for word by word.
Rules are regular expressions over the words, each with words that every match
holds: a text is matched only against rules whose words it has. Each match is an
interval of words; one that lies within another of the same or a higher priority
is dropped (of equal intervals the higher priority stays, then the earlier
rule). A text's score is the largest weight of what stays, or of its phrases.

Rules are written over words parted by single spaces. Words stand in the matched
text with a space before and after, so a rule never ends within a word and two
matches never share a space.

Defined results: a null text has no words, places or labels and score 0; lists
of labels without labels are empty texts; repeated rows are judged one by one; a
null id stays null; an empty table gives no rows; other columns play no part and
may have any name. A text is held with its words; work on it grows with its
words times the rules that it has the words for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, written


@dataclass(frozen=True)
class Rule:
    label: str
    #: Words that every match holds, the rarest first.
    needs: tuple[str, ...]
    pattern: str
    priority: int
    weight: float


#: Phrases and their labels, fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
PHRASE_WEIGHT = 0.8

#: Licenses with versions: label, needed words, name, versions. {v} is the version where it is part of a word.
VERSIONED = [
    ("gpl", "gnu general", r"gnu general public licen[cs]e(?: gpl)?", "1 2 3"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1 2 3"),
    ("gpl", "gplv{v}", r"(?:gnu )?gplv{v}(?: 0)?", "1 2 3"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?: lgpl)?", "2.1 3"),
    ("lgpl", "library general", r"gnu library general public licen[cs]e", "2"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2 2.1 3"),
    ("lgpl", "lgplv{v}", r"(?:gnu )?lgplv{v}(?: 0)?", "2 3"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e(?: agpl)?", "1 3"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1 3"),
    ("agpl", "agplv{v}", r"(?:gnu )?agplv{v}(?: 0)?", "3"),
    ("gfdl", "gnu documentation", r"gnu free documentation licen[cs]e(?: gfdl)?", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", "1 1.1 2"),
    ("apache", "apache {v}", r"apache v?{v}(?: 0)?", "2"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e(?: mpl)?", "1 1.1 2"),
    ("mpl", "mpl", r"mpl", "1 1.1 2"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?: epl)?", "1 2"),
    ("epl", "epl", r"epl", "1 2"),
    ("cpl", "common public", r"common public licen[cs]e(?: cpl)?", "1"),
    ("cddl", "cddl", r"cddl", "1 1.1"),
    ("cddl", "common development distribution", r"common development and distribution licen[cs]e(?: cddl)?", "1 1.1"),
    ("eupl", "eupl", r"eupl", "1.1 1.2"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: eupl)?", "1.1 1.2"),
    ("osl", "open software", r"open software licen[cs]e(?: osl)?", "1 2 2.1 3"),
    ("afl", "academic free", r"academic free licen[cs]e(?: afl)?", "1.2 2 2.1 3"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", "1 2"),
    ("ofl", "sil open font", r"sil open font licen[cs]e(?: ofl)?", "1 1.1"),
    ("ofl", "ofl", r"(?:sil )?ofl", "1 1.1"),
    ("bsl", "boost", r"boost software licen[cs]e", "1"),
    ("busl", "business source", r"business source licen[cs]e(?: busl)?", "1.1"),
    ("sspl", "server side public", r"server side public licen[cs]e(?: sspl)?", "1"),
    ("elastic", "elastic", r"elastic licen[cs]e", "2"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[cs]e(?: odbl)?", "1"),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[cs]e(?: odc by)?", "1"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e(?: upl)?", "1"),
    ("zpl", "zope", r"zope public licen[cs]e(?: zpl)?", "1.1 2 2.1"),
    ("cecill", "cecill", r"cecill(?: free software licen[cs]e)?", "1 1.1 2 2.1"),
    ("lppl", "latex project", r"latex project public licen[cs]e(?: lppl)?", "1 1.1 1.2 1.3"),
    ("psf", "python software foundation", r"python software foundation licen[cs]e", "2"),
]

#: The kinds of the Creative Commons' licenses: short and long names.
CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = "1 2 2.5 3 4"

#: Licenses without versions: label, needed words, name.
PLAIN = [
    ("mit", "license mit", r"(?:the )?mit(?: x11| expat)? license"),
    ("mit", "licence mit", r"(?:the )?mit(?: x11| expat)? licence"),
    ("mit", "expat", r"(?:the )?expat licen[cs]e"),
    ("bsd-2-clause", "bsd 2", r"(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd 3", r"(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd new", r"(?:new bsd|bsd new)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd revised", r"(?:revised bsd|bsd revised)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd 4", r"(?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("0bsd", "0bsd", r"0bsd(?: licen[cs]e)?"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("public-domain", "public domain", r"(?:is|are|in|into|to) the public domain"),
    ("pddl", "public domain dedication", r"public domain dedication(?: and)? licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("php", "php", r"php licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?"),
    ("json", "json", r"json licen[cs]e"),
    ("proprietary", "rights reserved", r"all rights reserved"),
]

#: Sentences and addresses that stand for a license: label, needed words, pattern.
NOTICES = [
    ("mit", "hereby granted obtaining", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby granted purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "compliance except", r"you may not use this file except in compliance with the license"),
    ("apache-2", "apache licenses", r"apache org licenses license 2 0"),
    ("gpl", "redistribute gnu general", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute gnu lesser", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute gnu affero", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("zlib", "misrepresented origin", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("mpl-2", "mozilla mpl", r"mozilla org mpl 2 0"),
    ("wtfpl", "fuck want", r"do what the fuck you want to public license"),
    ("beerware", "beer return", r"buy me a beer in return"),
    ("mit", "opensource licenses mit", r"opensource org licenses mit(?: license)?"),
    ("bsd-3-clause", "opensource licenses bsd", r"opensource org licenses bsd 3 clause"),
    ("cc0", "creativecommons publicdomain", r"creativecommons org publicdomain zero 1 0"),
]

_DECLARED = r"(?:licen[cs]ed|released|distributed|redistributed|published|available|provided|offered|covered|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


def _version(v: str) -> str:
    """A version as words: 2 is also 2 0, 2.1 is 2 1."""
    return v.replace(".", " ") if "." in v else f"{v}(?: 0)?"


def signature_rules() -> list[Rule]:
    """All rules in their order: tags, notices, declarations, names with versions, names alone."""
    versioned = list(VERSIONED)
    for kind, name in CC.items():
        versioned += [(f"cc-{kind.replace(' ', '-')}", f"cc {kind}", f"cc {kind}", CC_VERSIONS), (f"cc-{kind.replace(' ', '-')}", "creative commons attribution", f"creative commons {name}", CC_VERSIONS)]
    tags, declared, named, alone = {}, [], [], []
    for family, needs, name, versions in versioned:
        for v in versions.split():
            label, own = f"{family}-{v}", tuple(needs.replace("{v}", v).split())
            full = name.replace("{v}", v) if "{v}" in name else f"{name} (?:version |release )?v?{_version(v)}"
            declared.append(Rule(label, own, _DECLARED + full, 3, 0.95))
            named.append(Rule(label, own, full, 2, 0.8))
            tags[label] = f"{family.replace('-', ' ')} {v.replace('.', ' ') if '.' in v else f'{v} 0'}(?: only| or later)?"
        if "{v}" not in name:
            declared.append(Rule(family, tuple(needs.split()), _DECLARED + name, 2, 0.7))
            alone.append(Rule(family, tuple(needs.split()), name, 1, 0.5))
    for label, needs, name in PLAIN:
        declared.append(Rule(label, tuple(needs.split()), _DECLARED + name, 3, 0.95))
        named.append(Rule(label, tuple(needs.split()), name, 2, 0.4 if label == "proprietary" else 0.8))
        tags[label] = label.replace("-", " ")
    addresses = [Rule(f"cc-{k.replace(' ', '-')}-{v}", ("creativecommons", *k.split()), f"creativecommons org licenses {k} {_version(v)}", 3, 0.9) for k in CC for v in CC_VERSIONS.split()]
    notices = [Rule(label, tuple(needs.split()), pattern, 3, 0.9) for label, needs, pattern in NOTICES]
    return [Rule(label, ("spdx",), f"spdx licen[cs]e identifier {tag}", 4, 1.0) for label, tag in tags.items()] + notices + addresses + declared + named + alone


RULES = signature_rules()
_PRIORITIES = (1, 2, 3, 4)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(pattern: str) -> str:
    """A rule's pattern for words with a space on either side."""
    return f" {pattern.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')} "


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _listed(rules: list[Rule]) -> Column:
    return F.from_json(F.lit(json.dumps([{"rank": k, "needs": r.needs, "pattern": spaced(r.pattern)} for k, r in enumerate(rules)])), "array<struct<rank: int, needs: array<string>, pattern: string>>")


def _places(w: Column, phrases: dict[str, str]) -> Column:
    """Struct (start, label) of every place where a phrase's words stand in w, looked for where w has them all."""

    def of(phrase: str, label: str) -> Column:
        own = phrase.split()
        hit = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda j: F.get(w, i + j) == F.get(F.lit(own), j))
        has = F.forall(F.lit(own), lambda x: F.array_contains(w, x))
        some = F.filter(F.sequence(F.lit(0), F.size(w) - len(own)), lambda i: (F.get(w, i) == own[0]) & hit(i))
        return F.when(has & (F.size(w) >= len(own)), F.transform(some, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))).otherwise(F.array().cast("array<struct<start: long, label: string>>"))

    return F.concat(*[of(p, x) for p, x in phrases.items()])


def _matches(w: Column, rules: list[Rule]) -> Column:
    """For each rule that w has the words of, and that matches: its rank, its matches' words, and the words before each match since the one before."""
    text = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))
    fits = F.filter(_listed(rules), lambda r: F.forall(r["needs"], lambda x: F.array_contains(w, x)))
    count = lambda s: F.shiftright(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))), 1)  # noqa: E731  a word has a space on either side
    one = lambda t, r: F.struct(r["rank"].alias("rank"), F.transform(F.regexp_extract_all(t, r["pattern"], F.lit(0)), count).alias("sizes"), F.transform(F.split(t, r["pattern"], -1), count).alias("gaps"))
    return let(text, lambda t: F.transform(F.filter(fits, lambda r: F.regexp_like(t, r["pattern"])), lambda r: one(t, r)))


def matched(docs: DataFrame, rules: list[Rule] = RULES, phrases: dict[str, str] = PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, n_words, places, found) of each row of docs, as a written table without the texts; row is its key."""
    lower = lambda t: F.translate(t, _UPPER, _LOWER)
    rare = sorted({r.needs[0] for r in rules} | {max(p.split(), key=len) for p in phrases})
    places, found = "array<struct<start: long, label: string>>", "array<struct<rank: int, sizes: array<int>, gaps: array<int>>>"
    known = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def looked(w: Column) -> Column:
        n = F.size(w).cast("long").alias("n_words")
        own = let(_words(lower(known)), lambda v: F.struct(n, _places(v, phrases).cast(places).alias("places"), _matches(v, rules).cast(found).alias("found")))
        return F.when(F.arrays_overlap(w, F.lit(rare)), own).otherwise(F.struct(n, F.array().cast(places).alias("places"), F.array().cast(found).alias("found")))

    # F.lower also changes letters beyond A-Z, which neither makes nor breaks a rare word's gate: those are plain ASCII.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), let(_words(F.lower(known)), looked).alias("x"))
    return written(rows.select("row", "id", "x.*"))


def detections(matches: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(row, rank, label, weight, start, end) of the matches that no other holds, in words; a text's matches are sorted twice, not paired."""
    facts = F.from_json(F.lit(json.dumps([{"label": r.label, "priority": r.priority, "weight": r.weight} for r in rules])), "array<struct<label: string, priority: int, weight: double>>")
    each = matches.select("row", F.explode("found").alias("x")).select("row", "x.rank", "x.gaps", F.posexplode("x.sizes").alias("k", "size"))
    each = each.select("row", "rank", "k", "size", F.get("gaps", F.col("k")).alias("gap"))
    upto = Window.partitionBy("row", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    each = each.select("row", "rank", (F.col("end") - F.col("size")).alias("start"), "end", F.get(facts, F.col("rank")).alias("rule")).select("row", "rank", "start", "end", "rule.*")
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in _PRIORITIES]  # of those that start no later
    kept = each.withColumn("reach", F.get(F.array(*reach), F.col("priority") - _PRIORITIES[0])).where("reach is null or reach < end")
    return kept.select("row", "rank", "label", "weight", "start", "end")


def licensed(docs: DataFrame, rules: list[Rule] = RULES, phrases: dict[str, str] = PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, places, detections, labels, score) of each row of docs; labels are distinct and sorted."""
    rows = matched(docs, rules, phrases, key, text)
    found = detections(rows, rules).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "rank", "weight"))).alias("detections"), F.max("weight").alias("top"))
    out = rows.drop("found").join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.coalesce(F.col("detections.label"), F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("top", F.lit(0.0)), F.when(F.size("places") > 0, PHRASE_WEIGHT).otherwise(0.0))
    return out.select("id", "n_words", "places", "detections", labels.alias("labels"), score.alias("score"))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, start = licensed(table(spark, sf_dir, "documents")), F.col("places.start")
    base = F.array_join(F.array_sort(F.array_distinct("places.label")), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), base.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _sql(rules: list[Rule] = RULES, phrases: dict[str, str] = PHRASES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",".join(f"({k},{quoted(r.label)},[{','.join(map(quoted, r.needs))}],{quoted(spaced(r.pattern))},{r.priority},{r.weight})" for k, r in enumerate(rules))
    own = ",".join(f"({quoted(spaced(p))},{quoted(x)})" for p, x in phrases.items())
    count = lambda s: f"((length({s}) - length(replace({s}, ' ', ''))) // 2)"
    reach = " ".join(f"WHEN {p} THEN max(CASE WHEN priority >= {p} THEN stop END) OVER before" for p in _PRIORITIES)
    return f"""WITH r(rank, label, needs, pattern, priority, weight) AS (VALUES {values}), p(pattern, label) AS (VALUES {own}),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS MATERIALIZED (SELECT row, doc_id, len(w) AS n_words, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
m AS (SELECT row, 0 AS rank, p.label, regexp_extract_all(t, p.pattern) AS s, regexp_split_to_array(t, p.pattern) AS g FROM t, p WHERE regexp_matches(t, p.pattern)
  UNION ALL SELECT row, rank + 1, r.label, regexp_extract_all(t, r.pattern), regexp_split_to_array(t, r.pattern) FROM (FROM t WHERE list_has_any(w, [{','.join(map(quoted, sorted({r.needs[0] for r in rules})))}])) t JOIN r ON list_has_all(w, needs) AND regexp_matches(t, r.pattern)),
e AS (SELECT row, rank, label, unnest(s) AS s, unnest(g[:len(s)]) AS g, generate_subscripts(s, 1) AS k FROM m),
i AS (SELECT row, rank, label, sum({count('g')} + {count('s')}) OVER (PARTITION BY row, rank, label ORDER BY k) AS stop, {count('s')} AS size FROM e),
b AS (SELECT row, count(*) AS n_base, min(stop - size) AS first_word, max(stop - size) AS last_word, list(DISTINCT label) AS labels FROM i WHERE rank = 0 GROUP BY row),
x AS (SELECT i.row, i.label, weight, stop, CASE priority {reach} END AS reach FROM i JOIN r ON i.rank = r.rank + 1 WINDOW before AS (PARTITION BY i.row ORDER BY stop - size, stop DESC, priority DESC, i.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT row, list(DISTINCT label) AS labels, max(weight) AS top FROM x WHERE reach IS NULL OR reach < stop GROUP BY row)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(y.labels, [])))), ',') AS labels, CAST(greatest(coalesce(top, 0), CASE WHEN n_base > 0 THEN {PHRASE_WEIGHT} ELSE 0 END) AS DOUBLE) AS score
FROM t LEFT JOIN b USING (row) LEFT JOIN y USING (row)"""


OP13_SQL = _sql()
