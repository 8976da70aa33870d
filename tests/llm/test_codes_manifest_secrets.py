"""Vector codes, the Merkle manifest and the secret scan against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from flightloom.llm import codes, manifest, secret_scan


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Vector codes


def plain_codes(rows):
    """(vec_id, label, vector) rows, coded one after another in Python numbers."""
    kept = [(v, lab, [math.floor(4096 * x) for x in e]) for v, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(kept[0][2]) // 8
    parts = [[r[2][p * size : (p + 1) * size] for r in kept] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(6):
        for own, book in zip(parts, books):
            groups = {}
            for x in own:
                groups.setdefault(near(x, book)[1], []).append(x)
            for i, xs in groups.items():
                book[i] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(own[i], book) for own, book in zip(parts, books)] for i in range(len(kept))]
    print_ = sha(",".join(str(c) for book in books for e in book for c in e))
    error = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, lab, _), e in zip(kept, error):
        totals[lab] = totals.get(lab, 0) + e
    return sorted(((v, "".join(f"{i:02x}" for _, i in f), e, totals[lab], print_) for (v, lab, _), f, e in zip(kept, found, error)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, score double, part int"


def coded(spark, rows):
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], VECTORS.replace("embedding array<float>, label int", "label int, embedding array<float>"))
    return sorted((tuple(x) for x in codes.vector_codes(df.repartition(3)).collect()), key=str)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    some = [(i, i % 3 if i % 7 else None, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(60)]
    odd = [(100, 1, None), (101, 1, [None] * 16), (102, 1, [float("nan")] * 16), (103, 2, [float("inf")] * 16), (None, 2, [0.25] * 16), (3, 0, [0.5] * 16)]
    rows = some + odd + some[:5]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, some[:5]) == plain_codes(some[:5])  # fewer rows than entries
    same = [(i, 0, [0.1] * 16) for i in range(20)]
    assert coded(spark, same) == plain_codes(same)
    assert coded(spark, []) == [] and coded(spark, [(1, 1, None)]) == [] and coded(spark, [(1, 1, [0.5] * 15)]) == []


def test_rows_of_another_length_take_no_part(spark):
    rows = [(i, 0, [0.01 * i] * 16) for i in range(9)]
    assert coded(spark, [*rows, (20, 0, [0.5] * 24)]) == plain_codes(rows)


def test_components_without_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, 1, [1e9] * 16)])


@pytest.mark.parametrize(("bits", "cells", "scale"), [(4, 1 << 16, 300), (9, 1 << 16, 600), (9, 50, 4000), (12, 9, 1 << 20), (9, 1 << 16, 1 << 24)])
def test_memoised_cells_find_the_nearest(monkeypatch, bits, cells, scale):
    """Whatever the cells' size, with a memo that starts anew and with ties: the first nearest entry."""
    monkeypatch.setattr(codes, "SIDE_BITS", bits)
    monkeypatch.setattr(codes, "CELLS", cells)
    rng = np.random.default_rng(bits)
    entries = rng.integers(-scale, scale, (16, 4))
    entries[9] = entries[2]
    memo = codes.Cells(entries)
    for _ in range(3):
        parts = rng.integers(-2 * scale, 2 * scale, (500, 4))
        parts[:100] = entries[rng.integers(0, 16, 100)]
        parts[100:200] = (entries[3] + entries[5]) // 2
        index, distance = memo.nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_a_hash_of_two_cells_compares_with_all(monkeypatch):
    monkeypatch.setattr(codes, "mix", lambda x: np.zeros_like(x))  # every cell has one hash
    rng = np.random.default_rng(0)
    entries, parts = rng.integers(-4000, 4000, (16, 8)), rng.integers(-4000, 4000, (300, 8))
    index, _ = codes.Cells(entries).nearest(parts)
    assert (index == ((parts[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_cells_leave_entries_out():
    """In small boxes most entries can't be nearest, and cells that were met serve again."""
    rng = np.random.default_rng(1)
    memo = codes.Cells(rng.integers(-4000, 4000, (16, 2)))
    parts = rng.integers(-4000, 4000, (4000, 2))
    memo.nearest(parts)
    memo.nearest(parts)
    assert memo.evaluated < 4 * 8000 and memo.hits == 4000


# Merkle manifest


def plain_tree(nodes, run):
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, own = [], []
        for a in range(0, len(nodes), run):
            part = nodes[a : a + run]
            for j, group in enumerate(owners[a : a + run]):
                for o in group:
                    proofs[o].append(("".join(part[:j]), "".join(part[j + 1 :])))
            above.append(sha(*part))
            own.append(sum(owners[a : a + run], []))
        nodes, owners = above, own
    return nodes[0], proofs


def plain_manifest(rows, run=8):
    """(doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(field, (*r[:4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        made[g] = plain_tree([x[2] for x in groups[g]], run)
    root, tops = plain_tree([made[g][0] for g in order], run)
    out = []
    for g, top in zip(order, tops):
        for (_, _, own, r), proof in zip(groups[g], made[g][1]):
            steps = proof + top
            t = r[4]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            node = leaf(r, t)
            for a, b in steps:
                node = sha(a, node, b)
            out.append((r[0], own, made[g][0], root, sha(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(x) for x in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def manifest_rows(docs):
    return [(x.doc_id, x.source, x.lang, x.n_chars, x.text) for x in docs.collect()]


def test_manifest_of_documents(documents, nothing):
    """Nulls, empty and long texts, repeated rows and clashing columns are in the documents of the fixture."""
    clashing = documents.selectExpr("*", "'x' AS root", "'y' AS leaf", "1 AS part", "2 AS pos", "3 AS n", "4 AS held", "5 AS node")
    assert listed(manifest.document_manifest(clashing)) == plain_manifest(manifest_rows(documents))
    assert manifest.document_manifest(nothing).count() == 0


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 513])
def test_manifest_by_numbers_of_leaves(spark, count):
    rows = [(i, None, None if i % 5 == 0 and count > 8 else "é", 3, "Abc" if i % 2 else None) for i in range(count)]
    rows += [(None, "s", "z", None, "")] * (3 if count == 9 else 0)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert listed(manifest.document_manifest(df)) == plain_manifest(rows)


def test_manifest_over_many_rounds_and_groups(spark, monkeypatch):
    """Blocks of one level and runs of two: a tree of ten rounds, and of many groups."""
    monkeypatch.setattr(manifest, "RUN", 4)
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rows = [(i, "s", "big" if i % 3 else f"g{i % 50}", 1, f"Text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert listed(manifest.document_manifest(df)) == plain_manifest(rows, 4)


# Secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def entropy(w):
    return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))


def plain_added(t):
    """Each window's entropy worked out by itself."""
    out, last = [], 0
    for m in re.finditer("[A-Za-z0-9+/]{16,}", t):
        run = m[0]
        if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            continue
        before, last = t[last : m.start()], m.end()
        if any(re.search(p, run) for p in secret_scan.ALLOWED) or any(re.search(p, before) for p in secret_scan.ALLOWED_AFTER):
            continue
        for c in secret_scan.CLASSES:
            if len(run) >= c.window and re.fullmatch(f"[{c.only}]+", run) and all(re.search(h, run) for h in c.holds):
                high = [i for i in range(len(run) - c.window + 1) if entropy(run[i : i + c.window]) >= c.bits]
                out += [(m.start() + high[0], 3, m.start() + high[-1] + c.window)] if high else []
                break
    return out


def plain_report(t):
    base = plain_base(t)
    every = sorted(base + [x for x in plain_added(t) if not any(y[0] < x[2] and x[0] < y[2] for y in base)])
    said = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in s)
    return (*(sum(k == kind for _, k, _ in base) for kind in range(3)), sha(said(base)), said(every))


def reported(df):
    return {x.doc_id: (x.n_assign, x.n_access, x.n_hex, x.base_sha256, x.spans) for x in secret_scan.secret_report(df).collect()}


def test_secrets_of_random_texts(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    said = ["password=", "ToKen : '", 'api_key:"', "APIKEY = ", "secret=key", "AKIA", "sha256:", "base64,", "=", ":", "EXAMPLE", "ſecret=abcdefgh", "toKen=abcdefgh", "secret:token:abcdefgh"]
    pieces = [
        lambda: of("0123456789abcdef", rng.randint(10, 50)), lambda: of(letters, rng.randint(1, 30)), lambda: of(secret_scan.ALPHABET, rng.randint(10, 60)), lambda: " ",
        lambda: "é😀", lambda: rng.choice(said), lambda: "AKIA" + of("ABCDEFGH0123", 18), lambda: of("0123456789ABCDEF", 18), lambda: of(letters + "0123456789", 25),
    ]
    texts = ["".join(rng.choice(pieces)() for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += ["", "x" * 150_000, "1" * 30_000, " ".join(of("0123456789abcdef", 30) for _ in range(1500)), of(secret_scan.ALPHABET, 3000), " ".join(of(secret_scan.ALPHABET, 24) for _ in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = reported(df)
    assert [got[i] for i in range(len(texts))] == [plain_report(t) for t in texts]
    assert sum("entropy" in x[-1] for x in got.values()) > 100


def test_secrets_of_documents(documents, rows, nothing):
    """Null, empty and long texts, repeated rows, and columns of clashing names."""
    clashing = documents.selectExpr("*", "1 AS base_spans", "2 AS secret_spans", "'x' AS spans", "3 AS n_hex")
    got = secret_scan.secret_report(clashing).collect()
    want = [(d, *plain_report(t or "")) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert secret_scan.secret_report(nothing).count() == 0


def test_allow_lists_and_what_is_found(spark):
    cases = {
        "key qR7bK2xW9mZ4tLp8vN3c end": 1, "see qR7bK2xWexampleL4p8vN3c": 0, "sha256: qR7bK2xW9mZ4tLp8vN3c": 0, "checksum of qR7bK2xW9mZ4tLp8vN3c": 1,
        "data:image/png;base64,qR7bK2xW9mZ4tLp8vN3c": 0, "Donaudampfschifffahrtsgesellschaft2024": 0, "internationalization": 0, "4111111111111111111111": 0, "00000000aaaaaaaa1111": 0,
        "F3A9C27B1E5D8046 x": 1,
    }
    got = reported(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"))
    assert [got[i][-1].count("entropy") for i in range(len(cases))] == list(cases.values())


def test_the_scan_stays_in_sql_functions(spark, sf_dir):
    plan = secret_scan.secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
