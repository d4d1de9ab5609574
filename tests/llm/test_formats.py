"""Chat formatting, packing and WARC round trips."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat, packing, warc
from tidemark.llm.common import shared_folder

TEXT = st.text(alphabet=st.sampled_from("<|\\n\n >im_startend:é"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text)


def test_chats_round_trip(spark):
    rows = [(1, 0, "user", chat.CONTROL), (1, 1, "assistant", chat.CONTROL), (1, 2, "assistant", "é<\\|x"), (2, 1, None, None), (2, None, "system", "s"), (None, 0, "assistant", ""), (3, 0, "a\nb<n", "t"), (3, 0, "a\nb<n", "t")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.chain(table))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])) and got[1].n_turns == 3
    assert got[1].loss_sha256 == sha(chat.CONTROL + "é<\\|x") and got[1].loss_chars == len(chat.CONTROL) + 5
    assert got[2].turns_sha256 == sha("system\ns\n\n\n") and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and got[3].n_turns == 2 and len(got) == 4


def test_best_paths(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 4, 2.0), (2, 6, 99, None), (3, 7, 8, 1.0), (3, 8, 7, 1.0), (4, 9, None, 1.0), (4, 10, 9, 1.0), (4, 11, 9, 1.0)]
    got = chat.best_paths(spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, score double")).collect()
    assert sorted((r.tree_id, r.depth, r.msg_id) for r in got) == [(1, 0, 1), (1, 1, 3), (1, 2, 4), (1, 3, 5), (2, 0, 6), (4, 0, 9), (4, 1, 10)]


def test_long_chain_takes_few_joins(spark):
    rows = [(1, i, i - 1 if i else None, 0.0) for i in range(300)]
    got = chat.best_paths(spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, score double")).collect()
    assert sorted((r.depth, r.msg_id) for r in got) == [(i, i) for i in range(300)]


@pytest.mark.parametrize("seed", range(4))
def test_pack(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.005, 3000), 2048)
    lengths[:5] = 0
    bins, size, used = packing.pack(lengths)
    assert (np.bincount(bins, lengths) == used).all() and (used <= size).all()
    assert all(s == min(c for c in packing.SIZES if c >= u) for s, u in zip(size.tolist(), used.tolist(), strict=True))
    assert used.sum() / size.sum() > 0.98
    costs = sum(map(packing.default_cost, size.tolist()))
    one, _, _ = packing.pack(lengths, packing.SIZES[-1:])
    assert costs < (one.max() + 1) * packing.default_cost(packing.SIZES[-1])


def test_pack_documents(spark, monkeypatch):
    texts = ["a b c", None, "", " ".join(["w"] * 5000), "x", "x"] + ["q " * (7 * i % 300) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(4, "x", 1)], "doc_id long, text string, bin_id long")
    rows = packing.pack_documents(docs, shard=50).collect()
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.length
    assert all(words[i] == len((t or "").split()) * (2 if i == 4 else 1) for i, t in enumerate(texts))
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.bin_id, []).append(r)
    for own in by_bin.values():
        own.sort(key=lambda r: (r.place, r.length))
        assert sum(r.length for r in own) == own[0].used <= own[0].capacity
        at = 0
        for r in own:
            assert r.place == at
            at += r.length
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_warc(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # records and even magic straddle splits
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        evil = "x" * 300 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" + "é" * 500
        big = "p" * 1500
        pages = [(1, "http://a b%", evil), (2, None, None), (3, "u", big), (4, "u", big), (9, "u", big), (5, "v", "small"), (6, "v", "small"), (7, "w", evil), (8, "e", ""), (10, "z", "WARC/1.1\r\n"), (11, "z", "tail\r\n\r\n")]
        pages += [(12, "q", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n")] + [(100 + i, "n", f"row {i} " * (i % 40)) for i in range(60)]
        path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
        warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), path)
        got = {r.page_id: r for r in warc.page_records(warc.read_warc(spark, path, payloads=False)).collect()}
        assert len(got) == len(pages)
        for i, _, h in pages:
            raw = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 9, 4: 9, 1: 7}
        payloads = Counter(bytes(r.payload) for r in warc.read_warc(spark, path).collect())
        assert payloads[evil.encode()] == 1 and payloads[big.encode()] == 1 and sum(payloads.values()) == len(pages)
        none = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
        warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), none)
        assert warc.read_warc(spark, none, payloads=False).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_new_bin_is_priced_by_all_short_pieces_to_come():
    bins, sizes, used = packing.pack(np.ones(512, np.int64))
    assert sizes.tolist() == [512] and used.tolist() == [512] and not bins.any()


def naive_pack(lengths, sizes, cost):
    """Best fit by plain search: the fullest open bin with room, of equal ones the one filled last; else the size that fills cheapest."""
    todo = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, out = [], [0] * len(lengths)  # a bin: [size, used, time of its last change]
    for now, i in enumerate(todo):
        n = lengths[i]
        fit = [b for b, (size, used, _) in enumerate(bins) if size - used >= n]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0] - bins[b][1], -bins[b][2]))
        else:

            def price(size, n=n, now=now):
                filled = n
                for j in todo[now + 1 :]:  # longest first
                    if lengths[j] and filled + lengths[j] <= size:
                        filled += lengths[j]
                return cost(size) / max(filled, 1)

            size = min((s for s in sizes if s >= n), key=lambda s: (price(s), s))
            b = len(bins)
            bins.append([size, 0, 0])
        bins[b][1] += n
        bins[b][2] = now
        out[i] = b
    return out, [min(s for s in sizes if s >= used) for _, used, _ in bins], [used for _, used, _ in bins]


@pytest.mark.parametrize("seed", range(12))
def test_pack_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    sizes = [(16, 32, 64), (10, 100), (50,), (256, 512, 1024, 2048)][seed % 4]
    lengths = np.minimum(rng.geometric(0.05 if sizes[-1] < 200 else 0.004, 150) - (seed % 3 > 0), sizes[-1])
    got = [x.tolist() for x in packing.pack(lengths, sizes)]
    assert got == [list(x) for x in naive_pack(lengths.tolist(), sizes, packing.default_cost)]


def test_packing_follows_rows_alone(spark):
    rows = [(i // 3 if i % 5 else None, " ".join(["w"] * (i * 37 % 900))) for i in range(300)] + [(7, "same words here")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted((tuple(r) for r in packing.pack_documents(docs.repartition(n), (64, 256), shard=60).collect()), key=repr) for n in (1, 7))
    assert one == many and sum(r[0] == 7 and r[4] == 3 for r in one) == 200


def test_copies_are_numbered(spark):
    counted = spark.createDataFrame([("a", 1), ("b", 10), ("c", 7)], "x string, count long")
    got = sorted((r.x, r.copy) for r in packing.copies(counted, step=4).collect())
    assert got == sorted([("a", 0), *(("b", i) for i in range(10)), *(("c", i) for i in range(7))])


def test_packed_texts_make_up_the_texts(spark):
    texts = {1: "  a b  c\nd e f g ", 2: "", 3: None, 4: " \n ", 5: "é" * 9, 6: "x " * 1000}
    docs = spark.createDataFrame([*texts.items(), (5, "é" * 9)], "doc_id long, text string")
    rows = packing.packed_texts(docs, (3, 8)).collect()
    whole = {}
    for r in sorted(set(map(tuple, ((r.doc_id, r.piece, r.text) for r in rows)))):
        whole[r[0]] = whole.get(r[0], "") + r[2]
    assert whole == {k: v or "" for k, v in texts.items()}
    assert sum(r.doc_id == 5 for r in rows) == 2 and all(len(r.text.split()) == r.length for r in rows)


def plain_paths(rows, top):
    """Every root-to-leaf path by walking up, ranked by mean score, turns and leaf."""
    parent = {m: p if any(r[1] == p for r in rows) else None for _, m, p, _ in rows}
    score, tree = {m: s or 0.0 for _, m, _, s in rows}, {m: t for t, m, _, _ in rows}
    inner, paths = {p for p in parent.values() if p is not None}, {}
    for leaf in set(parent) - inner:
        path, seen = [leaf], {leaf}
        while parent[path[-1]] is not None and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if parent[path[-1]] is None:
            paths.setdefault(tree[leaf], []).append((-sum(score[m] for m in path) / len(path), -len(path), leaf, path[::-1]))
    return sorted((t, k + 1, m, d) for t, own in paths.items() for k, (*_, path) in enumerate(sorted(own)[:top]) for d, m in enumerate(path))


@pytest.mark.parametrize("top", [1, 3])
@pytest.mark.parametrize("seed", range(2))
def test_best_paths_against_walks(spark, seed, top):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(150):
        tree = int(rng.integers(5))
        own = [x[1] for x in rows if x[0] == tree]
        up = None if not own or rng.random() < 0.05 else int(rng.choice(own)) if rng.random() < 0.95 else 10_000
        rows.append((tree, m, up, None if m % 11 == 0 else float(rng.integers(0, 5))))
    rows += [(9, 900, 901, 1.0), (9, 901, 900, 1.0)]  # a cycle
    got = chat.best_paths(spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, score double"), top).collect()
    assert sorted((r.tree_id, r["rank"], r.msg_id, r.depth) for r in got) == plain_paths(rows, top)


def test_each_chosen_path_is_one_conversation(spark):
    rows = [(1, 1, None, 1.0, "user", "hi"), (1, 2, 1, 5.0, "assistant", "good"), (1, 3, 1, 2.0, "assistant", "fair"), (1, 4, 1, 0.0, "assistant", "bad")]
    messages = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, score double, role string, text string")
    got = {r["rank"]: chat.parse_chat(r.formatted) for r in chat.format_chats(messages, top=2).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "good")], 2: [("user", "hi"), ("assistant", "fair")]}
    assert chat.best_paths(messages.where("false")).count() == 0 and chat.format_chats(messages.where("false"), 2).count() == 0


def test_chats_with_long_texts_and_taken_ids(spark, tmp_path):
    long = "<|im_end|>é" * 200_000
    rows = [(-1, 5, "assistant", "mine"), (7, 0, "user", long), (7, 1, "assistant", long), (None, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert (got[7].n_turns, got[7].loss_chars) == (2, len(long)) and got[7].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[-1].n_turns == 3 and got[-1].loss_chars == len(chat.CONTROL) + 4 and got[None].n_turns == 1


def test_warc_keeps_urls_and_long_pages(spark):
    urls = ["http://a/%20b c\t%25\x7f\n", "%%20 %2520", "", None, "é ü", "x" * 300_000 + " "]
    long = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40_000
    pages = [(i, u, long if i == 5 else f"t{i}") for i, u in enumerate(urls)]
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in warc.page_records(warc.read_warc(spark, path, payloads=False)).collect()}
    assert [got[i].url for i in range(6)] == [u or "" for u in urls]
    assert (got[5].payload_bytes, got[5].payload_digest) == (len(long), hashlib.sha1(long.encode()).hexdigest())


def test_pages_tied_for_the_largest_id_are_all_responses(spark):
    big = "p" * 1200
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame([(3, "u", big), (9, "u", big), (9, "u", big), (None, "u", big)], "page_id long, url string, html string"), path)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.page_records(warc.read_warc(spark, path, payloads=False)).collect()))
    assert got == [(0, "revisit", 9), (3, "revisit", 9), (9, "response", None), (9, "response", None)]
