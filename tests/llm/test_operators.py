"""The corpus operators against brute force, on whole small tables and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import oracle
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import shoal.llm.simhash as simhash
from shoal.llm import decontam, linedup, packing, quality, registry, secrets, warc
from shoal.llm.components import components
from shoal.llm.exact import exact_duplicates
from shoal.llm.langid import identify_languages, train_languages
from shoal.llm.toxicity import score_toxicity, train_toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, removed_lines int, partners string, h int"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def awkward(spark, texts=("", None, " \t\n", "one", "one", "Two  words\nand\tmore", "Two words and more", "é ß 漢字 😀", "word " * 20000)):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns that clash."""
    rows = [(i, t, None if i % 2 else "en", None, None, "x", None, 3, "p", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "one", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def none(spark):
    return spark.createDataFrame([], DOC)


def pairs(df, *cols):
    return sorted(((tuple(r[c] for c in cols)) for r in df.collect()), key=repr)


# 10: exact


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n and j is not None]
        keep = min(ids, default=None)
        out.append((i, keep, norm.count(n), i is not None and i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_exact_awkward(spark, ranges):
    d = awkward(spark)
    assert pairs(exact_duplicates(d, ranges), *EXACT) == brute_exact([(r.doc_id, r.text) for r in d.collect()])


def test_exact_group_over_many_ranges(spark):
    d = spark.createDataFrame([(i, "same text" if i % 3 else f"own {i}") for i in range(900)], "doc_id long, text string")
    assert pairs(exact_duplicates(d, 20), *EXACT) == brute_exact([(r.doc_id, r.text) for r in d.collect()])
    assert exact_duplicates(none(spark)).count() == 0


def test_exact_oracle(spark):
    assert oracle.differences(registry.op10_exact_dedup(spark, SF).toPandas(), oracle.connect(SF).execute(registry.ORACLE_SQL["op10_exact_dedup"]).df()) == ""


# 7: SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, most=4):
    """Least position reachable for each fingerprint."""
    comp = list(range(len(fps)))
    while True:
        new = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= most) for i in range(len(fps))]
        if new == comp:
            return comp
        comp = new


def test_simhash_documents(spark):
    got = simhash.simhash_components(documents(spark)).toPandas().sort_values("doc_id")
    texts = documents(spark).toPandas().sort_values("doc_id").text
    fps = [brute_fingerprint(t) for t in texts]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == [int(got.doc_id.iloc[k]) for k in brute_components(fps)]


def test_simhash_awkward(spark):
    d = awkward(spark)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(d).collect()}
    zero = "0" * 16
    assert got[0, zero] == got[1, zero] == got[2, zero] == got[None, zero] == 0
    one = f"{brute_fingerprint('one'):016x}"
    assert got[3, one] == got[4, one] == got[None, one] == 3 and simhash.simhash_components(d).count() == d.count()
    assert simhash.simhash_components(none(spark)).count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_simhash_links_lose_nothing(spark, block):
    """A dense group and planted neighbours at 0 to 6 bits; small blocks split its keys."""
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = set(base)
    for f in base:
        for bits in range(1, 7):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(0, 30, 3) for j in range(31, 60, 4)}
    fps = sorted(fps)
    nodes = [f - (1 << 64) if f >> 63 else f for f in fps]
    comp = {r.node: r.component for r in components(simhash.simhash_links(spark.createDataFrame([(f,) for f in nodes], "fp long"), block=block)).collect()}
    first = {}
    for i, f in enumerate(nodes):
        first.setdefault(comp.get(f, f), i)
    assert [first[comp.get(f, f)] for f in nodes] == brute_components(fps)


def test_simhash_rows_without_id(spark):
    """Near copies without doc_id link others and never name a component."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(1000 + k if k % 4 else None, " ".join(words)), (None, " ".join([*words[:-1], "other"])), (500 + k if k % 3 == 0 else None, " ".join(["first", *words[1:]]))]
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(got, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=repr)
    assert len(set(comp)) < len(rows) and len(least) < len(set(comp))  # some are linked, and some groups have no id


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    up = list(range(31))
    find = lambda i: i if up[i] == i else find(up[i])
    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


# 3: packing


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path())
    for d in (documents(spark).limit(60), awkward(spark)):
        d = d.cache()
        got = packing.pack_documents(d, registry.tokenizer_path(), with_ids=True).toPandas()
        want = []
        for r in d.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            want += [(r.doc_id, k, k * 2048, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes()), p) for k, p in enumerate(ids[i : i + 2048] for i in range(0, len(ids), 2048))]
        rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in got.itertuples()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack_documents(none(spark), registry.tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(1, 12), st.sampled_from(["norm", "dot"]), st.integers(64 * 64, 3 * 64 * 64))
def test_pack_histogram_keeps_every_constraint(counts, docs, rule, attention):
    cap = packing.Capacity(64, docs, attention)
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, r0, r1, seq, copies, offset in packing.pack_histogram(counts, cap, rule=rule):
        for r in range(r0, r1):
            ranks[length].append(r)
            bins[seq + (r - r0) // copies].append((offset + (r - r0) % copies * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64 and len(placed) <= docs and sum(n * n for _, n in placed) <= attention
    assert sorted(bins) == list(range(len(bins)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZéÉßµ½'\"sSt.,-#09 \t\n\x1c\x85\xa0İſ한ΣΑσ😀<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]), max_size=40).map("".join), min_size=1, max_size=8))
def test_word_ids_equal_whole_encoding(texts):
    from tokenizers import Tokenizer

    encoder, plain = packing._encoder(registry.tokenizer_path()), Tokenizer.from_file(registry.tokenizer_path())
    got = {}
    for first, ids, c in encoder.encode(pa.array(texts), 7):
        got |= {first + i: ids[c[i] : c[i + 1]].tolist() for i in range(len(c) - 1)}
    assert [got[k] for k in range(len(texts))] == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_packing_special_tokens(spark):
    """Their strings in a text are the ids that the tokenizer gives them."""
    d = spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, "plain"), (3, "<|startoftext|>" * 3000)], "doc_id long, text string")
    got = packing.pack_documents(d, registry.tokenizer_path(), with_ids=True).toPandas().sort_values(["doc_id", "piece"])
    assert [list(x) for x in got.ids[:2]] == [[3306, 49407, 1002, 0], packing._encoder(registry.tokenizer_path()).tokenizer.encode("plain").ids + [0]]
    assert got.length.tolist()[2:] == [2048, 953]


def test_packing_binding_capacities(spark):
    """Few documents a sequence and a small attention cost bind before the tokens do."""
    d = spark.createDataFrame([(i, "w " * (i % 29)) for i in range(300)], "doc_id long, text string")
    got = packing.pack_documents(d, registry.tokenizer_path(), packing.Capacity(64, 3, 900)).toPandas()
    bins = got.groupby("sequence_id").length.agg(["sum", "size", lambda x: (x**2).sum()])
    assert len(got) == 300
    assert (bins["sum"] <= 64).all() and (bins["size"] <= 3).all() and (bins["<lambda_0>"] <= 900).all() and (bins["size"] == 3).any()


# 8: line dedup


PASSAGE = "\n".join(f"line {i} of a long passage that several documents hold in common here" for i in range(6))


def test_line_dedup(spark):
    own = lambda k: "\n".join(f"document {k} says its own thing number {i}" for i in range(4))
    d = spark.createDataFrame(
        [(1, f"{own(1)}\n{PASSAGE}\n{own(11)}"), (2, f"{PASSAGE}\n\n{own(2)}"), (3, f"{own(3)}\nAll rights reserved."), (4, f"All rights reserved.\n{own(4)}"), (5, own(1)), (6, f"{own(6)}\n {PASSAGE}  ")],
        "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines, r.partners) for r in linedup.dedup_lines(d).collect()}
    assert got[1][1] == got[3][1] == got[4][1] == 0 and got[3][0].endswith("reserved.")
    assert got[2] == (f"\n{own(2)}", 6, [1]) and got[6] == (own(6), 6, [1])
    assert got[5] == (own(1), 0, []) if sum(len(x.split()) for x in own(1).split("\n")) < linedup.MIN_WORDS else got[5] == ("", 4, [1])


def test_line_dedup_awkward(spark):
    long = PASSAGE + "\n" + PASSAGE
    d = awkward(spark, ("", None, "x\n" * 5, long, long, PASSAGE))
    got = pairs(linedup.dedup_lines(d), "doc_id", "text", "removed_lines")
    assert got == sorted([(0, "", 0), (1, None, 0), (2, "x\n" * 5, 0), (3, long, 0), (3, long, 0), (4, "", 12), (5, "", 6), (None, "one", 0), (None, None, 0)], key=repr)
    assert linedup.dedup_lines(none(spark)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=9, unique_by=(lambda p: p[0], lambda p: p[1])))
def test_patience_is_longest(points):
    run = linedup.patience(points)
    best = [1] * len(points)
    order = sorted(points)
    for i, (_, r) in enumerate(order):
        best[i] = 1 + max([best[j] for j in range(i) if order[j][1] < r], default=0)
    assert len(run) == max(best, default=0) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:]))


# 9: decontamination


def brute_leaks(rows, items):
    """(doc_id, item_id): question's share 0.8 and answer's 0.5 of 5-word shingles, over the whole text."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def held(part, w, there):
        if len(part) < 5:
            return float(any(w[i : i + len(part)] == part for i in range(len(w) - len(part) + 1)))
        return len(grams(part) & there) / len(grams(part))

    out = set()
    for doc_id, text in rows:
        w = words(text)
        there = grams(w)
        for item_id, item in items:
            q, a = decontam.question_and_answer(item)
            if (q or a) and held(q, w, there) >= 0.8 and held(a, w, there) >= 0.5:
                out.add((doc_id, item_id))
    return out


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_leaks([(r.doc_id, r.text) for r in documents(spark).collect()], items)
    got = registry.op9_decontamination(spark, SF)
    assert set(pairs(got, "doc_id", "item_id")) == want and want


def test_decontamination_verifies_question_and_answer(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "ce", "di", "fo"]) + rng.choice(["lu", "ma", "no", "pi"]) + rng.choice(["r", "s", "t"])
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{some(20)}?\n{some(8 if k % 2 else 3)}.") for k in range(30)] + [(30, some(12)), (31, some(3))]
    rows = []
    for k, t in items:
        q, _, a = t.partition("\n")
        rows += [(10 * k, f"{some(90)} {t} {some(200)}"), (10 * k + 1, f"{some(50)} {q} {some(60)}"), (10 * k + 2, f"{some(9)} {a} {some(9)}"), (10 * k + 3, f"{some(9)} {q.replace('?', '')} {a} {some(500)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.benchmark_leaks(docs, bench).collect()}
    assert set(got) == brute_leaks(rows, items) >= {(10 * k, k) for k, _ in items}
    assert not {(10 * k + 1, k) for k in range(30)} & set(got) and all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.5 for r in got.values())
    # One index or many: the same items with the same scores.
    many = {(r.doc_id, r.item_id): r for r in decontam.benchmark_leaks(docs, bench, chars=400).collect()}
    assert set(many) == set(got) and all(abs(many[k].score - got[k].score) < 1e-12 for k in got)


def test_wand_finds_what_full_scoring_finds():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou")
    index = decontam.ItemIndex([(i, " ".join(word() for _ in range(rng.randrange(3, 30)))) for i in range(60)])
    size = len(index.vocabulary)
    drawn = [np.array(sorted(rng.sample(range(size), 25))) for _ in range(60)]
    got = {k: set() for k in range(60)}
    for k, inside, blocks in index.open_blocks(np.repeat(np.arange(60), 25), np.concatenate(drawn), 0.3):
        got[k] = {at for at, _ in index.search(inside, blocks, 0.3)}
    for k, terms in enumerate(drawn):
        score = Counter()
        for t in terms.tolist():
            for p in range(index.first[index.at[t]], index.first[index.at[t + 1]]):
                score[int(index.item[p])] += index.impact[p]
        assert got[k] == {at for at, x in score.items() if x >= 0.3}
    assert any(got.values())


def test_decontamination_awkward(spark):
    bench = spark.createDataFrame([(1, "Who wrote the long and winding book about whales at sea?\nIt was Herman Melville in 1851."), (2, None), (3, ""), (4, "!!"), (1, "Who wrote the long and winding book about whales at sea?\nIt was Herman Melville in 1851.")], "item_id long, text string")
    leak = "who WROTE the long and winding book, about whales at sea? it was herman melville in 1851!"
    d = awkward(spark, ("", None, "word " * 5000 + leak + " word" * 5000, leak, "whales at sea"))
    assert pairs(decontam.benchmark_leaks(d, bench), "doc_id", "item_id") == [(2, 1), (3, 1), (3, 1)]
    assert decontam.benchmark_leaks(none(spark), bench).count() == 0 and decontam.benchmark_leaks(d, bench.where("item_id = 9")).count() == 0


# 2: secrets


def test_secrets_base(spark):
    got = {r.doc_id: r for r in registry.op2_secrets(spark, SF).collect()}
    for r in documents(spark).collect():
        t, spans = r.text or "", []
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
            spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 8)
        for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[0]) >= least]
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(x for *_, x in sorted(spans)).encode()).hexdigest()
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_secrets_novelty(spark):
    code = "def connect(client_secret_name):\n    return client_secret_name\n" * 5
    text = f'{code}# bearer Zx9qLw0PkT7vRb2mYc4N and secret: short\ncredential client_secret_name\n'
    *_, spans, n = secrets.scan_text(text)
    start = text.index("Zx9q")
    assert (spans, n) == (f"novel:{start}:{start + 20}", 1)
    assert secrets.marginal_ratio("client_secret_name", code, "") < 0.6 < secrets.RATIO <= secrets.marginal_ratio("Zx9qLw0PkT7vRb2mYc4N", code, "")
    d = awkward(spark)
    assert secrets.scan_secrets(d).where("spans = '' and n_novel = 0").count() == d.count() and secrets.scan_secrets(none(spark)).count() == 0


# 4: archives


def test_warc(spark):
    d = spark.createDataFrame([(1, "http://a b", "x"), (2, None, "x"), (3, "u\nv", None), (4, "u", ""), (None, "u", "x"), (7, "u", "é\r\n\r\nz"), (7, "u", "é\r\n\r\nz"), (8, "", "y" * 300_000), (None, "u", "alone")], "page_id long, url string, html string").selectExpr("*", "'c' as kept", "1 as digest")
    got = pairs(warc.archive_pages(d), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    keep = {"x": 2, "": 4}
    want = [(r.page_id, len((r.html or "").encode()), digest(r.html or ""), *(("revisit", keep[r.html or ""]) if (r.html or "") in keep and r.page_id != keep[r.html or ""] else ("response", None))) for r in d.collect()]
    assert got == sorted(want, key=repr)
    assert {r[3] for r in pairs(warc.archive_pages(d, least_bytes=2), "page_id", "payload_bytes", "payload_digest", "record_type")} == {"response"}
    assert warc.archive_pages(d.limit(0)).count() == 0


def test_warc_pages(spark):
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in registry.op4_warc(spark, SF).collect()}
    assert got == {r.page_id: (len(r.html.encode()), warc.payload_digest(r.html.encode())) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc /%:", min_size=1).filter(lambda u: u.strip() == u), st.binary(max_size=80)), max_size=5), st.sampled_from([1, 2]))
def test_arc_round_trip(pages, version):
    arc = warc.write_arc([warc.ArcRecord(u, "1.2.3.4", "19990102030405", "text/plain", "200", body) for u, body in pages], version)
    got = list(warc.read_arc(BytesIO(arc)))
    assert [(r.url, r.ip, r.date, r.body) for r in got] == [(u, "1.2.3.4", "19990102030405", body) for u, body in pages]
    record = b"".join(warc.warc_record(r, i, warc.payload_digest(r.body)) for i, r in enumerate(got))
    back = list(warc.read_warc(BytesIO(record)))
    assert [p for *_, p in back] == [body for _, body in pages] and all(h["WARC-Date"] == "1999-01-02T03:04:05Z" for h, *_ in back)


def test_arc_damage():
    arc = warc.write_arc([warc.ArcRecord("u", "1.1.1.1", "19990101", "t/p", "200", b"body")], 1)
    for bad in (arc[:-3], b"no header\n", arc.replace(b"u 1.1.1.1 19990101 t/p 4", b"u 1.1.1.1 4")):
        with pytest.raises(ValueError):
            list(warc.read_arc(BytesIO(bad)))


# 1, 5, 6: classifiers, on the folds they don't learn from


def held(df, truth, on="doc_id"):
    j = df.toPandas().merge(truth.toPandas(), on=on)
    return j[j.held_out]


def auc(score, y):
    r, p = pd.Series(score).rank().to_numpy(), np.asarray(y) == 1
    return (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / max(1, p.sum() * (~p).sum())


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op1_toxicity(spark, sf)
    j = held(got, spark.read.parquet(f"{sf}/labels.parquet"))
    assert (j.predicted == j.toxic).mean() >= 0.93 and auc(j.score, j.toxic) >= 0.7
    assert j.predicted[j.toxic == 0].sum() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.collect())


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    j = held(registry.op5_quality(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    assert auc(j.score, j.quality) >= 0.98 and (j.predicted == j.quality).mean() >= 0.95


def test_language(spark):
    d = documents(spark)
    j = held(registry.op6_language(spark, SF), d.select("doc_id", "lang"))
    assert (j.lang_pred == j.lang).mean() >= 0.97
    model = train_languages(d)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(spark.createDataFrame([(1, None), (2, "12 !!"), (3, "")], "doc_id long, text string"), model).collect()}
    assert set(got.values()) == {("und", 0.0)}
    assert identify_languages(d, model, reject=1.1).where("lang_pred <> 'und'").count() == 0


def test_classifiers_awkward(spark):
    d, empty_labels = awkward(spark), labels(spark).limit(0)
    odd = spark.createDataFrame([(0, None, None), (3, 1, 1), (3, 0, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for y in (empty_labels, odd, labels(spark)):
        tox = train_toxicity(d, y)
        good = quality.train_quality(d, y)
        for docs in (d, none(spark)):
            for out in (score_toxicity(docs, tox), quality.score_quality(docs, good)):
                got = out.collect()
                assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert identify_languages(d, train_languages(none(spark))).count() == d.count()
    assert identify_languages(none(spark), train_languages(d)).count() == 0


def test_no_label_lang_or_source_in_scores(spark):
    d = documents(spark)
    blind = d.selectExpr("doc_id", "text", "'zz' as lang", "'s' as source", "0L as n_chars")
    model = train_toxicity(d, labels(spark))
    assert pairs(score_toxicity(d, model), "doc_id", "score") == pairs(score_toxicity(blind, model), "doc_id", "score")
