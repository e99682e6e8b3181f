"""Licences by the Dice coefficient over word bigrams: notices, headers and whole texts.

A text is lower-cased and everything but letters, digits and line ends becomes a space.  Two kinds of units are compared:

* lines, paragraphs and the whole text with short notices (``TEMPLATES``, ``NOTICES``, ``TITLES``).  A unit of n bigrams
  and a template of m can reach the threshold only if ``2 * min(n, m) / (n + m)`` does.  Templates have no bigram twice,
  so the overlap is the number of template bigrams that the unit has;
* runs of words anywhere, across lines and paragraphs, with ``TEMPLATES``, ``NOTICES`` and the files in
  ``licence_texts`` (``BODIES``: grants, headers, title blocks and whole licences).  A run of set size n must hold at
  least ``t / (2 - t)`` of a template's bigrams to reach the threshold t, so only templates with that many in the text
  are looked at.  ``2 * overlap / (n + m) >= t`` is a sum over the run's bigrams, 2 - t for one of the template and -t for
  another, that reaches ``t * m``; so the run with the greatest sum is taken (the end by one pass, the start by one pass
  back from it; a template bigram counts once, other bigrams at each occurrence) and its coefficient is that of the two
  sets.

The licence is that of the best run of a body, else of the best notice as a unit, else of the best notice as a run.  So a
body counts before a sentence that several licences share.  Most texts have none of the ``ANCHORS``, words of which every
match with a template of at most ``SHORT`` bigrams has one, and are too short for the longer templates; they are left
after a search for these words.

Everything happens inside the row with built-in functions: one scan, no shuffle, no join.

Edge cases: null and blank texts have no licence and dice 0; units of fewer than two words match nothing; of equal
coefficients the longer body and the notice whose name is last count; ``n_license_lines`` counts lines that are a notice
as a whole; rows that repeat a ``doc_id`` are separate rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
NOT_TEXT = r"[^\p{L}\p{N}\n]+"

#: Short notices and first clauses; a licence may have several. The SQL twin reads these.
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0"),
)


_CC = {"": "Attribution", "-SA": "Attribution-ShareAlike", "-NC": "Attribution-NonCommercial", "-ND": "Attribution-NoDerivatives",
       "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"gpl": ("General", ("1", "2", "3")), "lgpl": ("Lesser General", ("2.1", "3")), "agpl": ("Affero General", ("3",))}
_NAMED = {"apache-1.1": "Apache License, Version 1.1", "apache-2.0": "Apache License 2.0", "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License",
          "bsl-1.0": "Boost Software License, Version 1.0", "isc": "ISC License", "mit": "MIT License", "mpl-1.1": "Mozilla Public License, version 1.1",
          "mpl-2.0": "Mozilla Public License, version 2.0", "unlicense": "Unlicense", "zlib": "zlib License"}


def _gnu(version: str) -> str:
    return version if "." in version else f"{version}.0"


#: More notices, for units and runs; each version has its own, so that none is taken for another.
NOTICES = (
    *((f"cc-by{k.lower()}-{v}", f"Licensed under CC BY{k} {v}") for k in _CC for v in ("1.0", "2.0", "2.5", "3.0", "4.0") if (k, v) not in {("", "4.0"), ("-NC", "4.0"), ("-SA", "4.0")}),
    *((f"cc-by{k.lower()}-{v}", f"This work is licensed under a Creative Commons {name} {v} {port} License") for k, name in _CC.items() for v, port in (("3.0", "Unported"), ("4.0", "International"))),
    *((f"{k}-{_gnu(v)}", f"{start} licensed under the GNU {name} Public License, version {v}") for k, (name, versions) in _GNU.items() for v in versions
      for start in ("This work is", "This program is", "This software is") if (start, v) != ("This work is", "3")),
    *((k, f"{start} under the {name}") for k, name in _NAMED.items() for start in ("Released", "Licensed", "Distributed")
      if (start, k) not in {("Released", "mit"), ("Licensed", "bsd-3-clause"), ("Licensed", "mpl-2.0")}),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: For lines, paragraphs and whole texts only: inside a sentence they would be a mention.
TITLES = (
    *((k, f"{the}{name}") for k, name in _NAMED.items() for the in ("", "The ")),
    ("mit", "The MIT License (MIT)"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    *((f"{k}-{_gnu(v)}", f"GNU {name} Public License version {v}") for k, (name, versions) in _GNU.items() for v in versions),
    *((k, f"SPDX-License-Identifier: {k}") for k in ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "ISC", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")),
    *((f"{k}-{_gnu(v)}", f"SPDX-License-Identifier: {k}-{_gnu(v)}{end}") for k, (_, versions) in _GNU.items() for v in versions for end in ("", "-only", "-or-later")),
)
TITLES = tuple((name.lower(), t) for name, t in TITLES if len(t.split()) > 1)


def _bodies() -> tuple[tuple[str, str], ...]:
    """Grants, headers, title blocks and whole licences as published: files <licence>[.<part>].txt."""
    files = sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name)
    return tuple((re.sub(r"(\.[a-z]+)?\.txt$", "", f.name), f.read_text(encoding="utf-8")) for f in files if f.name.endswith(".txt"))


BODIES = _bodies()
SHORT = 400


def bigrams(notice: str) -> list[str]:
    words = re.sub(r"[^\w]+|_", " ", notice.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _anchors(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with one of the templates has one at least.

    Such a unit has ``least`` of the m bigrams, so fewer than that many may be without an anchor.
    """
    common = set("a all and any as be by for from in is it may not of on or that the this to under use used with work you your".split())
    chosen: set[str] = set()
    open_ = []
    for grams in templates:
        least = next(n for n in range(1, len(grams) + 1) if 2.0 * n / (n + len(grams)) >= threshold)
        open_.append(([tuple(g.split(" ")) for g in grams], least))
    while open_ := [(rest, least) for grams, least in open_ if len(rest := [g for g in grams if not chosen & set(g)]) >= least]:
        gains = Counter(w for grams, _ in open_ for w in {w for g in grams for w in g})
        weight = Counter(w for grams, _ in open_ for g in grams for w in set(g))
        chosen.add(max(gains, key=lambda w: (w not in common and len(w) > 2, gains[w], weight[w], w)))
    return sorted(chosen)


def _literal(grams: list[str]) -> str:
    return f"split('{','.join(grams)}', ',')"


def _templates(notices: list[tuple[bool, str, list[str]]]) -> Column:
    """One constant; as text, since a call for each bigram takes seconds."""
    return F.expr("array(" + ", ".join(f"named_struct('body', {body}, 'm', {len(g)}, 'name', '{name}', 'grams', {_literal(g)})" for body, name, g in notices) + ")")


def _reaches(n: Column, m: Column, threshold: float) -> Column:
    return 2.0 * F.least(n, m) / (n + m) >= threshold


def _matches(units: Column, notices: tuple[tuple[str, str], ...], threshold: float) -> Column:
    """For each unit the templates that reach the threshold, as (dice, name).

    Each step keeps what the next one needs, as a lambda's inner expressions are evaluated at every use.
    """
    templates = _templates([(False, name, bigrams(t)) for name, t in notices])
    sizes = sorted({len(bigrams(t)) for _, t in notices})
    worded = F.transform(units, lambda u: F.struct(F.split(u, " ").alias("words")))
    worded = F.transform(worded, lambda s: F.struct(s["words"].alias("words"), (F.size(s["words"]) - 1).alias("n")))
    near = F.filter(worded, lambda s: (s["n"] > 0) & _reaches(s["n"], F.greatest(F.lit(sizes[0]), F.least(F.lit(sizes[-1]), s["n"])), threshold))
    paired = F.transform(near, lambda s: F.struct(s["n"].alias("n"), F.zip_with(
        F.slice(s["words"], 1, s["n"]), F.slice(s["words"], 2, s["n"]), lambda a, b: F.concat(a, F.lit(" "), b)).alias("grams")))

    def scored(s: Column) -> Column:
        fits = F.filter(templates, lambda t: _reaches(s["n"], t["m"], threshold))
        dice = F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(t["grams"], s["grams"])) / (s["n"] + t["m"])).alias("dice"), t["name"].alias("name")))
        return F.filter(dice, lambda d: d["dice"] >= threshold)

    return F.transform(paired, scored)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _heaviest(hits: Column, threshold: float) -> Column:
    """First and last place of the run with the greatest sum; ``hits`` are (i, k): the places in the text and the number of the bigram."""
    gain, none = 2.0 - threshold, F.array().cast("array<int>")

    def step(acc: Column, hit: Column, gap: Column, reset: bool) -> Column:
        left = acc["sum"] - threshold * gap
        return _let(F.greatest(left, F.lit(0.0)) if reset else left, lambda left: _let(
            F.when(left <= 0, none).otherwise(acc["seen"]) if reset else acc["seen"], lambda seen: _let(
                F.array_contains(seen, hit["k"]), lambda old: _let(F.when(old, left).otherwise(left + gain), lambda total: F.struct(
                    total.alias("sum"), hit["i"].alias("at"), F.when(old, seen).otherwise(F.concat(seen, F.array(hit["k"]))).alias("seen"),
                    F.greatest(total, acc["best"]).alias("best"), F.when(total > acc["best"], hit["i"]).otherwise(acc["place"]).alias("place"))))))

    def empty(at: Column) -> Column:
        return F.struct(F.lit(0.0).alias("sum"), at.alias("at"), none.alias("seen"), F.lit(0.0).alias("best"), at.alias("place"))

    last = F.aggregate(hits, empty(hits[0]["i"]), lambda acc, hit: step(acc, hit, hit["i"] - acc["at"] - 1, True), lambda acc: acc["place"])
    return _let(last, lambda last: F.struct(
        F.aggregate(F.reverse(F.filter(hits, lambda h: h["i"] <= last)), empty(last),
                    lambda acc, hit: step(acc, hit, F.greatest(acc["at"] - hit["i"] - 1, F.lit(0)), False), lambda acc: acc["place"]).alias("first"), last.alias("last")))


def _runs(flat: Column, threshold: float) -> Column:
    """Templates that a run of the text reaches, as (body, dice, m, name)."""
    known = [(body, name, bigrams(t)) for body, notices in ((True, BODIES), (False, TEMPLATES + NOTICES)) for name, t in notices]
    templates = _templates(known)
    every = F.expr(_literal(list(dict.fromkeys(g for *_, grams in known for g in grams))))

    def dice(t: Column, text: Column) -> Column:
        places = F.transform(text, lambda g, i: F.struct(i.alias("i"), F.array_position(t["grams"], g).cast("int").alias("k")))
        run = _let(F.filter(places, lambda p: p["k"] > 0), lambda hits: _heaviest(hits, threshold))
        found = _let(run, lambda r: F.array_distinct(F.slice(text, r["first"] + 1, r["last"] - r["first"] + 1)))
        return _let(found, lambda u: F.struct(t["body"].alias("body"), (2.0 * F.size(F.array_intersect(t["grams"], u)) / (F.size(u) + t["m"])).alias("dice"),
                                              t["m"].alias("m"), t["name"].alias("name")))

    def of(text: Column) -> Column:
        met = _let(F.array_intersect(text, every), lambda have: F.filter(templates, lambda t: _reaches(F.least(F.size(have), t["m"]), t["m"], threshold) & _reaches(
            F.size(F.array_intersect(t["grams"], have)), t["m"], threshold)))
        return F.filter(F.transform(met, lambda t: dice(t, text)), lambda d: d["dice"] >= threshold)

    return _let(F.split(flat, " "), lambda w: _let(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)), of))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``license`` and ``dice`` of its best unit or run (null and 0 without one) and ``n_license_lines``."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), NOT_TEXT, " ")
    notices = TEMPLATES + NOTICES + TITLES
    sizes = [len(bigrams(t)) for _, t in notices]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    grams = [bigrams(t) for _, t in notices + BODIES]
    anchors = _anchors([g for g in grams if len(g) <= SHORT], threshold)
    long = min(len(g) for g in grams if len(g) > SHORT) * threshold / (2 - threshold) - 1

    def count(u: Column, c: str) -> Column:
        return F.length(u) - F.length(F.replace(u, F.lit(c)))

    def anchored(u: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(u, F.lit(w)) for w in anchors])

    lines = F.filter(F.split("plain", "\n"), lambda u: (count(u, " ") >= least) & (count(u, " ") <= most + 2) & anchored(u))
    # paragraphs and the whole text, unless they are one line; a line end adds at most two spaces to those between words
    wider = F.filter(F.array_union(F.split("plain", "\n ?\n[\n ]*"), F.array("plain")),
                     lambda u: (F.instr(u, "\n") > 0) & (count(u, " ") - 2 * count(u, "\n") <= most) & anchored(u))
    flat = F.trim(F.regexp_replace("plain", "[\n ]+", " "))
    cut = docs.select("doc_id", plain.alias("plain")).select("doc_id", "plain", anchored(F.col("plain")).alias("anchored"))
    cut = cut.select("doc_id", F.when(F.col("anchored"), lines).otherwise(F.array().cast("array<string>")).alias("lines"),
                     F.when(F.col("anchored"), wider).otherwise(F.array().cast("array<string>")).alias("wider"),
                     F.when(F.col("anchored") | (count(F.col("plain"), " ") + count(F.col("plain"), "\n") >= long), flat).alias("flat"))
    spaced = cut.select("doc_id", "flat", F.transform("lines", lambda u: F.trim(u)).alias("lines"),
                        F.transform("wider", lambda u: F.trim(F.regexp_replace(F.translate(u, "\n", " "), " +", " "))).alias("wider"))
    found = spaced.select("doc_id", _matches(F.col("lines"), notices, threshold).alias("by_line"), _matches(F.col("wider"), notices, threshold).alias("by_wider"),
                          F.when(F.col("flat").isNotNull(), _runs(F.col("flat"), threshold)).alias("runs"))
    body = F.array_max(F.transform(F.filter("runs", lambda r: r["body"]), lambda r: F.struct(r["dice"], r["m"], r["name"])))
    unit = F.array_max(F.flatten(F.concat("by_line", "by_wider")))
    run = F.array_max(F.transform("runs", lambda r: F.struct(r["dice"], r["name"])))
    best = F.when(body.isNotNull(), F.struct(body["dice"].alias("dice"), body["name"].alias("name"))).otherwise(F.coalesce(unit, run))
    n_lines = F.size(F.filter("by_line", lambda m: F.size(m) > 0)).cast("long")
    return found.select("doc_id", best.alias("best"), n_lines.alias("n_license_lines")).select(
        "doc_id", F.col("best")["name"].alias("license"), F.coalesce(F.col("best")["dice"], F.lit(0.0)).alias("dice"), "n_license_lines")
