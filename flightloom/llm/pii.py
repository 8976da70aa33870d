"""Personal data: base patterns, and further spans by a character tagger (see tagger.py) trained on labelled spans.

Each kind holds a digit, an at sign or a bracketed "at"; the tagger reads all text within ``AROUND`` characters of one,
in overlapping windows (to read every character costs more than an operator may take, see the README). Every character
takes its tag from the window in which it lies farthest from an edge, and spans are read off the tags of the whole
region. A span so found is added if its digits can be of the kind and it touches no base span.

The training texts are windows of the corpus. Labelled spans come from templates of many written forms, most of which
no base pattern takes, put between words of these windows; and from what the base patterns find there. All other
numbers of the corpus teach the tagger what to leave alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import bounded_batches, give_back, slices
from flightloom.llm.tagger import PAD, Tagger, fit_tagger, symbols

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A failing start within a run of digits fails at the run's first digit too, so each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
AROUND, WINDOW, STRIDE = 32, 64, 32
#: Documents sampled for training, and windows at most used of them.
TRAIN_DOCS, TRAIN_WINDOWS = 20_000, 4_000

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    at = [int(x) for x in reversed(digits)]
    return (sum(at[::2]) + sum(sum(divmod(2 * x, 10)) for x in at[1::2])) % 10 == 0


def plain_digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(d := plain_digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(plain_digits(m.group())) <= 15]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of a text that lie near a trigger."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows_of(a: int, b: int) -> list[int]:
    """Starts of overlapping windows over a region."""
    return list(range(a, max(a + 1, b - STRIDE), STRIDE))


def cut_windows(text: str, starts: list[int], end: int) -> np.ndarray:
    out = np.full((len(starts), WINDOW), PAD, np.int64)
    for k, s in enumerate(starts):
        held = symbols(text[s : min(end, s + WINDOW)])
        out[k, : len(held)] = held
    return out


def reconcile(starts: list[int], tags: np.ndarray, a: int, b: int) -> np.ndarray:
    """Tags of a region: each character's from the window in which it lies farthest from an edge. Two windows at most hold it."""
    at = np.arange(b - a)
    best = np.clip((at - STRIDE // 2) // STRIDE, 0, len(starts) - 1)
    return tags[best, at - best * STRIDE]


def read_spans(tags: np.ndarray, a: int, text: str) -> list[Span]:
    """Runs of one kind's tags; tag 1 + 2k begins a span of kind k and 2 + 2k goes on with it."""
    out, start, kind = [], None, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        own = (t - 1) // 2 if t else -1
        if start is not None and (own != kind or t % 2):
            out.append((kind, a + start, a + i))
            start = None
        if start is None and t:
            start, kind = i, own
    trimmed = []
    for kind, s, e in out:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            trimmed.append((kind, s, e))
    return trimmed


def plausible(kind: int, held: str) -> bool:
    """Whether the digits of a span can be of its kind, however they are written; of an address, whether it has a name, an at and a dot."""
    digits, numbers = plain_digits(held), re.findall("[0-9]+", held)
    if kind == 0:
        name, at, place = re.split(r"(@|\bat\b)", held, maxsplit=1, flags=re.I) if re.search(r"@|\bat\b", held, re.I) else (held, "", "")
        return bool(at and re.search(r"\w", name) and re.search(r"\w.*(?:\.|\bdot\b).*\w", place, re.I))
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(numbers) > 1


def added_spans(model: Tagger | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the tagger for each text, those kept."""
    out: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return out
    jobs = [(i, a, b) for i, x in enumerate(texts) for a, b in regions(x)]
    for k in range(0, len(jobs), 64):
        group = [(i, a, b, windows_of(a, b)) for i, a, b in jobs[k : k + 64]]
        tags = [model.decode(cut_windows(texts[i], s[j : j + 512], b)) for i, a, b, s in group if len(s) > 512 for j in range(0, len(s), 512)]
        small = [g for g in group if len(g[3]) <= 512]
        flat = np.concatenate([cut_windows(texts[i], s, b) for i, a, b, s in small]) if small else np.zeros((0, WINDOW), np.int64)
        decoded = np.concatenate([model.decode(flat[j : j + 512]) for j in range(0, len(flat), 512)]) if len(flat) else flat
        long_at = short_at = 0
        for i, a, b, s in group:
            if len(s) > 512:
                n = -(-len(s) // 512)
                own = np.concatenate(tags[long_at : long_at + n])
                long_at += n
            else:
                own = decoded[short_at : short_at + len(s)]
                short_at += len(s)
            for kind, x, y in read_spans(reconcile(s, own, a, b), a, texts[i]):
                if plausible(kind, texts[i][x:y]) and all(y <= p or q <= x for _, p, q in base[i]):
                    out[i].append((kind, x, y))
    return out


def find_spans(model: Tagger | None, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans by kind and start, of each text."""
    near = [i for i, x in enumerate(texts) if x and TRIGGER.search(x)]
    base: list[list[Span]] = [[] for _ in texts]
    full = list(base)
    for i in near:
        base[i] = base_spans(texts[i])
    for i, more in zip(near, added_spans(model, [texts[i] for i in near], [base[i] for i in near])):
        full[i] = sorted({*base[i], *more})
    return base, full


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def template_span(kind: int, rng: random.Random) -> str:
    """A datum of a kind in one of many written forms."""
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        name = letters(2, 8) + rng.choice(["", number(2), "." + letters(3, 7), "_" + letters(2, 6), "." + number(2), "-" + letters(2, 6)])
        at = rng.choice(["@", " @ ", "[at]", " [at] ", " (at) ", "(at)", " {at} ", " [AT] "])
        dot = rng.choice([".", ".", " [dot] ", "[dot]", "(dot)", " (dot) ", " dot "]) if at != "@" else "."
        place = [letters(3, 9) + rng.choice(["", number(1)]), *([letters(4, 8)] if rng.random() < 0.5 else []), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])]
        return (name.title() if rng.random() < 0.1 else name) + at + dot.join(place)
    if kind == 1:
        return rng.choice([".", "[.]", "(.)", " . ", "{.}", "[dot]", " dot "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = rng.choice("3456") + number(14)
        d += next(x for x in "0123456789" if luhn(d + x))
        gap = rng.choice(["", " ", "-", ".", "/", "  ", "_", " - "])
        return gap.join(d[i : i + 4] for i in range(0, 16, 4))
    area, a, b = number(3), number(3), number(4)
    country = rng.choice(["1", "33", "34", "44", "49"])
    return rng.choice([f"+{country} ({area}) {a}-{b}", f"+{country} {area} {a} {b}", f"00{country} {area} {a} {b}", f"00{country}-{area}-{a}{b}", f"({area}) {a}-{b}", f"({area}) {a} {b}", f"{area}-{a}-{b}", f"0{area[:2]}/{a}{b}", f"{area}.{a}.{b}", f"+{country}.{area}.{a}.{b}"])


def labelled(text: str, spans: list[Span]) -> list[int]:
    tags = [0] * len(text)
    last = 0
    for kind, s, e in sorted(spans, key=lambda x: x[1:]):  # of overlapping kinds the first
        if s >= last:
            tags[s:e] = [1 + 2 * kind] + [2 + 2 * kind] * (e - s - 1)
            last = e
    return tags


def with_template(text: str, tags: list[int], rng: random.Random) -> tuple[str, list[int]]:
    """A span put in at a blank outside of other spans."""
    gaps = [i for i, x in enumerate(text) if x == " " and not tags[i]]
    kind = rng.randrange(len(KINDS))
    made = template_span(kind, rng)
    at = rng.choice(gaps) if gaps else len(text)
    return text[:at] + " " + made + text[at:], tags[:at] + [0, 1 + 2 * kind] + [2 + 2 * kind] * (len(made) - 1) + tags[at:]


def training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows and their tags: each region as it is, and with a template's span put in."""
    for batch in slices(batches, "text"):
        keys, held_windows, held_tags = [], [], []
        for text in batch.column("text").to_pylist():
            if not text or not TRIGGER.search(text):
                continue
            all_tags = labelled(text, base_spans(text))
            for a, b in regions(text):
                rng = random.Random(hashlib.md5(text[a:b].encode()).digest())
                own, tags = text[a:b], all_tags[a:b]
                for made, made_tags in ((own, tags), with_template(own, tags, rng), with_template(own, tags, rng)):
                    starts = windows_of(0, len(made))
                    cut = cut_windows(made, starts, len(made))
                    for k, s in enumerate(starts):
                        t = np.zeros(WINDOW, np.int8)
                        t[: min(WINDOW, len(made) - s)] = made_tags[s : s + WINDOW]
                        keys.append(int.from_bytes(hashlib.md5(cut[k].tobytes()).digest()[:7], "big"))
                        held_windows.append(cut[k].astype("<i2").tobytes())
                        held_tags.append(t.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held_windows, pa.binary()), pa.array(held_tags, pa.binary())], names=["key", "window", "tags"])


def train_pii(docs: DataFrame) -> Tagger | None:
    """Fit on windows of about ``TRAIN_DOCS`` documents, by a hash of the text; None where no window has a span."""
    texts = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, TRAIN_DOCS / max(1, docs.count()))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    with bounded_batches(docs.sparkSession):
        held = sample.mapInArrow(training_windows, "key long, window binary, tags binary").orderBy("key", "window").limit(TRAIN_WINDOWS).toPandas()
    if not any(any(x) for x in held["tags"]):
        return None
    windows = np.array([np.frombuffer(x, "<i2") for x in held["window"]]).astype(np.int64)
    tags = np.array([np.frombuffer(x, np.int8) for x in held["tags"]]).astype(np.int64)
    return fit_tagger(windows, tags, 1 + 2 * len(KINDS))


def report(model: Tagger | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        base, full = find_spans(model, batch.column("text").to_pylist())
        counts = [pa.array([sum(k == kind for k, _, _ in x) for x in base], pa.int64()) for kind in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(shown(x).encode()).hexdigest() for x in base]), pa.array([shown(x) for x in full])], names=["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"])


def detect_pii(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every row.

    Null and empty texts have no span; whole texts are read, however long. Only doc_id and text are read, so further
    columns play no part. Repeated rows each get their row, an empty table gives none.
    """
    model = model or train_pii(docs)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(report, model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(model: Tagger | None, text: str) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    _, (spans,) = find_spans(model, [text])
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(model: Tagger | None, text: str = "text") -> Column:
    """A text column with personal data replaced; null stays null. It is a function of the text alone, so rows that share ids change alike."""

    @F.arrow_udf("string")
    def change(column: pa.Array) -> pa.Array:
        out = pa.array((x if not x or not TRIGGER.search(x) else redact(model, x) for x in (y.as_py() for y in column)), pa.string(), size=len(column))
        give_back()
        return out

    return change(F.col(text))
