"""Secrets in text: three base patterns, and stretches of high entropy, in SQL functions only; no row leaves its task.

Candidates are whole runs of letters, digits, + and / with a digit and a letter. By the characters that it holds a run is of one class (hexadecimal, one
case with digits, both cases with digits); runs of letters or of digits alone are words and numbers. A window
of the class's length slides over the run. The sum of c log2 c over the counts of its characters is kept up to date by the
character that enters and the one that leaves, and gives the window's Shannon entropy. From the first to the last
window that reaches the class's threshold is a span, unless the allow-list suppresses it or it touches a base span.

Places are code points. A text is cut by a pattern twice, into matches and into what lies between them; running sums of
their lengths are the places. Running values are built in pieces of PIECE, so work grows with a text's length, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order; the last is the method's.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: one that is too short holds no shorter start that would do, so the least length stands in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGNED = 6


class EntropyClass(NamedTuple):
    """Runs that hold each of ``holds`` and nothing but ``only``: windows of ``window`` characters with at least ``bits`` of entropy count."""

    only: str
    holds: tuple[str, ...]
    window: int
    bits: float


#: The first class that fits a run is its own.
CLASSES = (
    EntropyClass("0-9a-fA-F", ("[0-9]", "[a-fA-F]"), 16, 3.01),
    EntropyClass("0-9a-z", ("[0-9]", "[a-z]"), 20, 3.61),
    EntropyClass("0-9A-Z", ("[0-9]", "[A-Z]"), 20, 3.61),
    EntropyClass("0-9a-zA-Z+/", ("[0-9]", "[a-z]", "[A-Z]"), 20, 3.71),
)
#: Whole runs of 16 and more that hold a digit and a letter; looked for at a run's start only, so a long run is read once.
CANDIDATE = "(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[0-9+/]*+[A-Za-z])[A-Za-z0-9+/]{16,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
#: Runs that are public by what they hold: placeholders, counted-up alphabets, a word with its number.
ALLOWED = ("(?i)example|sample|placeholder|x{8}", "0123456789|abcdefghij|ABCDEFGHIJ", "^[A-Za-z]+[0-9]{1,4}$")
#: And by what stands before them: checksums and embedded pictures.
ALLOWED_AFTER = ("(?i)(sha-?(1|224|256|384|512)|md5|integrity|checksum)[\"']?[:= -]{1,3}[\"']?$", "(?i)base64,$")
#: Sums of c log2 c are kept as whole numbers of this many parts.
PARTS, PIECE = 1 << 20, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """Running values of an array of ints under an associative ``op``; ``start`` is neutral."""

    def fold(part: Column, first: Column) -> Column:
        grown = F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(part))

    def pieces(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / PIECE).cast("int")), lambda k: F.slice(held, k * PIECE + 1, PIECE))

    def whole(held: Column) -> Column:
        totals = F.transform(held, lambda part: F.aggregate(part, F.lit(start), op))
        return let(F.concat(F.array(F.lit(start)), fold(totals, F.lit(start))), lambda before: F.flatten(F.transform(held, lambda part, k: fold(part, F.get(before, k)))))

    return F.when(F.size(values) > 0, let(let(values, pieces), whole)).otherwise(F.array().cast("array<int>"))


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern: structs of start, end, ``held`` (the group's text) and ``before`` (what lies between the last match and this one)."""
    regex = F.lit(pattern)
    own = [F.regexp_extract_all(text, regex, F.lit(group)).alias("group")] if group else []
    cut = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("before"), *own)
    found = F.filter(cut, lambda x: x["match"].isNotNull())  # one more piece than matches
    ends = lambda held: running(F.transform(held, lambda x: F.length(x["before"]) + F.length(x["match"])), lambda a, b: a + b, 0)
    out = lambda held: F.zip_with(held, ends(held), lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["group" if group else "match"].alias("held"), x["before"].alias("before")))
    return F.when(text.rlike(pattern), let(found, out)).otherwise(F.array().cast("array<struct<start int, end int, held string, before string>>"))


def spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def high_windows(run: Column, held: EntropyClass) -> Column:
    """(first, last): where the first window of high entropy of a run begins and the last ends; first is -1 without any."""
    n = held.window
    g = [0, *(round(c * math.log2(c) * PARTS) for c in range(1, n + 1))]
    grow = F.array(*(F.lit(b - a) for a, b in zip(g, g[1:])))  # what the sum gains when a count c becomes c + 1
    most = int(n * (math.log2(n) - held.bits) * PARTS)
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = let(codes, lambda x: F.zip_with(x, F.concat(F.array_repeat(F.lit(0), n), F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0)))), lambda a, b: F.struct(a.alias("into"), b.alias("out"))))
    begin = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("read"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(state: Column, x: Column) -> Column:
        left = F.transform(state["counts"], lambda c, i: c - ((i == x["out"]) & (i > 0)).cast("int"))
        lost = F.when(x["out"] > 0, F.get(grow, F.get(state["counts"], x["out"]) - 1)).otherwise(0)

        def entered(counts: Column) -> Column:
            total = state["sum"] - lost + F.get(grow, F.get(counts, x["into"]))
            read = state["read"] + 1
            high = (read >= n) & (total <= most)
            return F.struct(
                F.transform(counts, lambda c, i: c + (i == x["into"]).cast("int")).alias("counts"),
                total.alias("sum"),
                read.alias("read"),
                F.when(high & (state["first"] < 0), read - n).otherwise(state["first"]).alias("first"),
                F.when(high, read).otherwise(state["last"]).alias("last"),
            )

        return let(left, entered)

    return F.aggregate(steps, begin, step, lambda state: F.struct(state["first"], state["last"]))


def class_windows(run: Column) -> Column:
    """``high_windows`` of a run by its class; null without one."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<first int, last int>"))
    for held in CLASSES:
        fits = ~run.rlike(f"[^{held.only}]") & (F.length(run) >= held.window)
        for x in held.holds:
            fits = fits & run.rlike(x)
        out = out.when(fits, high_windows(run, held))
    return out


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED, allowed_after: tuple[str, ...] = ALLOWED_AFTER) -> Column:
    """Spans of high entropy of a text that no entry of the allow-lists suppresses."""

    def free(x: Column) -> Column:
        out = F.lit(True)
        for p in allowed:
            out = out & ~x["held"].rlike(p)
        for p in allowed_after:
            out = out & ~x["before"].rlike(p)
        return out

    high = F.transform(F.filter(places(text, CANDIDATE), free), lambda x: let(class_windows(x["held"]), lambda w: F.struct((x["start"] + w["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + w["last"]).alias("end"), w["first"].alias("first"))))
    return F.transform(F.filter(high, lambda x: x["first"] >= 0), lambda x: F.struct(x["start"], x["kind"], x["end"]))


def base_spans(text: Column) -> Column:
    assigned = F.filter(places(text, ASSIGN, 2), lambda x: F.length(x["held"]) >= ASSIGNED)
    return F.array_sort(F.concat(spans(assigned, 0), spans(places(text, ACCESS), 1), spans(places(text, HEX), 2)))


def with_untouched(base: Column, added: Column) -> Column:
    """Base spans and those added ones that share no character with one, in order."""
    far = 2**31 - 1

    def kept(both: Column) -> Column:
        reached = running(F.transform(both, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        ahead = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(far))), lambda a, b: F.least(a, b), far))
        held = F.arrays_zip(both.alias("span"), reached.alias("reached"), ahead.alias("ahead"))
        free = F.filter(held, lambda x: (x["span"]["kind"] < 3) | ((x["reached"] <= x["span"]["start"]) & (x["ahead"] >= x["span"]["end"])))
        return F.transform(free, lambda x: x["span"])

    return F.when(F.size(added) == 0, base).otherwise(let(F.array_sort(F.concat(base, added)), kept))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Adds ``base_spans`` and ``secret_spans``: arrays of (start, kind, end), kind by its number in KINDS, in that order; kept columns of these names are replaced.

    A null text counts as empty and has none. Every row is scanned by itself, whole: repeated rows give repeated results.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("base_spans", base_spans(text)).withColumn("secret_spans", entropy_spans(text))
    return found.withColumn("secret_spans", with_untouched(F.col("base_spans"), F.col("secret_spans")))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; see ``find_secrets``. Only doc_id and text are read."""
    made = find_secrets(docs.select("doc_id", "text"))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(of_kind, range(3))
    return made.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
