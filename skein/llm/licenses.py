"""Operator 6: license scans by an exact set-similarity join. Built-in functions only.

Texts are sequences of lower-cased words, and templates are sets of words. A
text holds a template where a *window* of consecutive words, lines aside, has
at least ``threshold`` of the template's distinct words; a window is as long
as the template divided by ``threshold``, so a notice may be wrapped over lines
or take in some words, and words scattered over a long line are none. Tokens
are ordered by their frequency over all texts, rarest first. A template's
*prefix* (its first m - need + 1 tokens) shares a token with every window that
holds it, so each prefix token of a text, with the template words around it,
meets the templates in an equi-join; surroundings with fewer than ``need``
words of the template drop out, and windows from every start in the rest are
counted exactly. The order steers only the cost, never the result.

Windows of one place are one block: on a line, windows that start within the
words of the first; across lines likewise, but only apart from lines that hold
the template themselves, whose share is told by their own words. Where no line
is longer than the window, lines that hold a template are one block each.

Exact phrases (``PHRASES``) are found as consecutive words, apart from the join.

Cases: null text is the empty text (no words, no labels, score 0); repeated
rows are scanned one by one; an empty table gives an empty result; only the
key and the text column are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.scratch import save

# Fixed values of the contract: consecutive words and their label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Common license notices (label, words of the notice); a parameter of scan_licenses.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("lgpl", "you can redistribute it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "copyright all rights reserved no part may be reproduced without permission"),
]
THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"     # a word character in either case
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
MAX_TEMPLATE_WORDS = 100_000                          # bound on the configuration, checked


def phrase_pattern(phrases: Sequence[tuple[str, str]]) -> str:
    body = "|".join(f"{GAP}+".join(p.split()) for p, _ in sorted(phrases, key=lambda x: -len(x[0])))
    return f"(?i)(?<!{WORD})(?:{body})(?!{WORD})"


def _label(match: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Label of a matched place, told by its words joined with single spaces."""
    plain = F.regexp_replace(F.lower(match), f"{GAP}+", " ")
    out = F.lit(None).cast("string")
    for p, name in phrases:
        out = F.when(plain == p, name).otherwise(out)
    return out


def _words(match: Column) -> Column:
    return F.regexp_count(match, F.lit(f"{WORD}+"))


def need_of(size: int, threshold: float) -> int:
    """Fewest shared words that reach the containment threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def span_of(words: str, threshold: float) -> int:
    """Length of a template's window in words."""
    return math.ceil(len(words.split()) / threshold - 1e-9)


def _places(windows: Column, m: Column) -> Column:
    """(n, best): blocks among the windows in order of their start, and the greatest share.

    A block across lines is open until a window starts behind it, and falls if a line's own block reaches into it."""
    zero = F.struct(F.lit(-1).alias("line_end"), F.lit(-1).alias("open_end"), F.lit(0).alias("open_best"),
                    F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("best"))

    def state(line_end, open_end, open_best, n, best):
        return F.struct(line_end.alias("line_end"), open_end.alias("open_end"), open_best.alias("open_best"),
                        n.cast("bigint").alias("n"), best.alias("best"))

    def step(a, w):
        closed = (a["open_end"] >= 0) & (w["s"] > a["open_end"])
        n = a["n"] + F.when(closed, 1).otherwise(0)
        best = F.when(closed, F.greatest(a["best"], a["open_best"])).otherwise(a["best"])
        own = state(F.when(w["s"] > a["line_end"], w["e"]).otherwise(a["line_end"]), F.lit(-1), F.lit(0),
                    n + F.when(w["s"] > a["line_end"], 1).otherwise(0), F.greatest(best, w["k"]))
        more = state(a["line_end"], a["open_end"], F.greatest(a["open_best"], w["k"]), a["n"], a["best"])
        return F.when(w["one_line"], own).when(w["s"] <= a["line_end"], a) \
            .when((a["open_end"] >= 0) & ~closed, more).otherwise(state(a["line_end"], w["e"], w["k"], n, best))

    def finish(a):
        last = a["open_end"] >= 0
        return F.struct((a["n"] + F.when(last, 1).otherwise(0)).cast("bigint").alias("n"),
                        (F.when(last, F.greatest(a["best"], a["open_best"])).otherwise(a["best"]) / m).alias("best"))

    return F.aggregate(windows, zero, step, finish)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                  phrases: Sequence[tuple[str, str]] = PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks).

    score: the greatest share of a template held by a block that reaches the
    threshold, 1.0 with an exact phrase, else 0.0. n_blocks: (block, template)
    pairs found."""
    sets = [(name, sorted(set(words.split())), span_of(words, threshold)) for name, words in templates]
    if sum(len(t) for _, t, _ in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words for a configuration list")
    vocab = sorted({w for _, t, _ in sets for w in t})
    least = min([need_of(len(t), threshold) for _, t, _ in sets], default=1)
    widest = max([span for _, _, span in sets], default=1)
    pattern = phrase_pattern(phrases)

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    places = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    plain = F.regexp_replace(F.lower("_t"), GAP_IN_LINE + "+", " ")
    tokens = F.split(F.regexp_replace(plain, " ?\n[ \n]*", " \n"), " ")       # a line's first word follows its \n
    known = F.filter(F.transform(tokens, lambda w, i: F.struct(i.alias("p"), w.alias("w"))),
                     lambda x: x["w"].startswith("\n") | x["w"].isin(vocab))
    known = F.transform(known, lambda x: F.struct(x["p"].alias("p"), x["w"].startswith("\n").alias("first"),
                                                  F.ltrim(x["w"], F.lit("\n")).alias("w")))
    known = F.transform(known, lambda x: F.struct(x["p"].alias("p"), x["first"].alias("first"),
                                                  F.when(x["w"].isin(vocab), x["w"]).alias("w")))
    rows = docs.select(F.col(key).alias("_key"), t.alias("_t")) \
        .select("_key", "_t", _words(F.col("_t")).cast("bigint").alias("n_words"),
                places.alias("_m"), known.alias("_known")) \
        .withColumn("_cut", F.when(F.size("_m") > 0, F.split("_t", pattern, -1))) \
        .select(F.expr("uuid()").alias("_row"), "_key", "n_words", F.size("_m").cast("bigint").alias("n_base"),
                F.when(F.size("_m") > 0, _words(F.element_at("_cut", 1))).cast("bigint").alias("first_word"),
                F.when(F.size("_m") > 0, F.col("n_words") - _words(F.element_at("_cut", -1))
                       - _words(F.element_at("_m", -1))).cast("bigint").alias("last_word"),
                F.array_sort(F.array_distinct(F.transform("_m", lambda m: _label(m, phrases)))).alias("_base"),
                F.when(F.size(F.array_distinct(F.filter("_known.w", lambda w: w.isNotNull()))) >= least,
                       F.col("_known")).alias("_known"))
    rows = save(rows, "licenses")          # one pass over the texts; row ids are fixed from here on

    # Global token order: rarest first. One row per template word, so bounded by the configuration.
    seen = {r["w"]: r["n"] for r in
            rows.select(F.explode("_known.w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (seen.get(w, 0), w)))}
    index, whole = [], []
    for name, words, span in sets:
        order = sorted(words, key=rank.get)
        need = need_of(len(order), threshold)
        whole.append((name, order, len(order), need, span))
        index += [(w, name) for w in order[:len(order) - need + 1]]
    spark = docs.sparkSession
    if not vocab:
        found = spark.createDataFrame([], "_row string, _names array<string>, score double, n_blocks bigint")
    else:
        index_df = spark.createDataFrame(index, "w string, name string").join(
            spark.createDataFrame(whole, "name string, words array<string>, m int, need int, span int"), "name")
        # Positions differ, so as many neighbours in the list as the widest window has words are enough.
        anchors = F.filter(F.transform("_known", lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["w"].alias("w"))),
                           lambda x: x["w"].isin(sorted({w for w, _ in index})))
        near = F.transform(anchors, lambda x: F.struct(x["p"].alias("p"), x["w"].alias("w"), F.slice(
            "_known", F.greatest(x["i"] - widest + 2, F.lit(1)), F.lit(2 * widest)).alias("around")))
        near = rows.select("_row", F.explode(near).alias("_a")).select("_row", "_a.p", "_a.w", "_a.around") \
            .join(F.broadcast(index_df), "w") \
            .withColumn("around", F.filter("around", lambda x: (F.abs(x["p"] - F.col("p")) < F.col("span"))
                                           & (x["first"] | F.array_contains("words", x["w"])))) \
            .filter(F.size(F.array_intersect("around.w", "words")) >= F.col("need"))

        def window(s):
            """Scopes from a start: its line, and lines aside; the words and the last position of the one that counts."""
            inside = F.filter("around", lambda x: (x["p"] >= s["p"]) & (x["p"] < s["p"] + F.col("span")))
            turn = F.array_min(F.transform(F.filter(inside, lambda x: x["first"] & (x["p"] > s["p"])), lambda x: x["p"]))
            mine = F.filter(inside, lambda x: F.array_contains("words", x["w"]))
            line = F.filter(mine, lambda x: turn.isNull() | (x["p"] < turn))

            def scope(xs, one_line):
                return F.struct(s["p"].alias("s"), F.array_max(F.transform(xs, lambda x: x["p"])).alias("e"),
                                F.size(F.array_distinct(F.transform(xs, lambda x: x["w"]))).alias("k"),
                                F.lit(one_line).alias("one_line"))
            return F.array(scope(line, True), scope(mine, False))

        starts = F.filter("around", lambda x: (x["p"] <= F.col("p")) & F.array_contains("words", x["w"]))
        windows = F.transform(starts, lambda s: F.element_at(F.filter(
            F.concat(window(s), F.array(F.lit(None))), lambda x: x.isNull() | (x["k"] >= F.col("need"))), 1))
        hits = near.select("_row", "name", "m", F.explode(windows).alias("_w")).filter("_w is not null") \
            .groupBy("_row", "name", "m").agg(F.array_sort(F.collect_set("_w")).alias("_ws")) \
            .select("_row", "name", _places(F.col("_ws"), F.col("m")).alias("_f"))
        found = hits.groupBy("_row").agg(F.collect_set("name").alias("_names"), F.max("_f.best").alias("score"),
                                         F.sum("_f.n").alias("n_blocks"))
    every = F.array_sort(F.array_union("_base", F.coalesce("_names", F.array().cast("array<string>"))))
    return rows.join(found, "_row", "left").select(
        F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"))
