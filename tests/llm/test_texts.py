"""Chat formatting, packing and SentencePiece against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marketloom.llm import chat, packing, queries, sentencepiece_bpe, textops

EVENTS = "conv_id long, seq long, event string, turn long, role string, text string"
DOCS = "doc_id long, text string, length long, ids string, rank int, salt int"


def folded(events):
    """The messages of each conversation, by replaying its log."""
    out = {}
    for conv in {e[0] for e in events}:
        own = [e for e in events if e[0] == conv]
        turns = {}
        for turn in sorted({e[3] for e in own}, key=lambda t: (t is not None, t or 0)):
            cuts = [e[1] for e in own if e[2] == "regenerate" and e[3] < turn]
            log = sorted((e for e in own if e[3] == turn and (not cuts or e[1] >= max(cuts))), key=lambda e: (e[1], e[2], e[4] or "", e[5] or ""))
            messages = []
            for _, _, event, _, role, text in log:
                if event == "message" or not messages:
                    messages.append([role, text or ""] if event != "regenerate" else [role, ""])
                elif event == "delta":
                    messages[-1][1] += text or ""
                else:
                    messages[-1][1] = text or ""
                messages[-1][0] = messages[-1][0] if messages[-1][0] is not None else role
            turns[turn] = [(r or "", t) for r, t in messages]
        out[conv] = [m for t in turns.values() for m in t]
    return out


def read(spark, events):
    rows = chat.read_chats(chat.format_chats(spark.createDataFrame(events, EVENTS))).collect()
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in rows}


def test_chat_replays_deltas_edits_and_regenerations(spark):
    rng = random.Random(4)
    events = []
    for conv in range(20):
        seq = 0
        for turn in range(rng.randint(1, 5)):
            events.append((conv, seq, "message", turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["", "hello", None, "é\\"])))
            for _ in range(rng.randint(0, 4)):
                seq += 1
                events.append((conv, seq, rng.choice(["delta", "delta", "edit"]), turn, None, rng.choice(["a", "<s>", " [/ROLE] ", "\n"])))
            seq += 1
        if conv % 3 == 0:
            events.append((conv, seq + 1, "regenerate", 0, None, "again"))
            events.append((conv, seq + 2, "message", 1, "assistant", "new"))
    want = folded(events)
    assert {k: v[0] for k, v in read(spark, events).items()} == want
    assert read(spark, events)[0][1] == "".join(t for r, t in want[0] if r == "assistant")


def test_chat_reads_back_hostile_texts(spark):
    rng = random.Random(9)
    parts = [*chat.Template().controls, "\\", "\\\\", " ", "ROLE]", "<", "x", "\n", "é", "</s", "s>"]
    events = [(c, t, "message", t, rng.choice(["user", "assistant", "".join(rng.choices(parts, k=3))]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for c in range(120) for t in range(3)]
    got = read(spark, events)
    for conv in range(120):
        want = [(e[4], e[5]) for e in events if e[0] == conv]
        assert got[conv] == (want, "".join(t for r, t in want if r == "assistant"))


def test_chat_edge_rows(spark):
    assert read(spark, []) == {}
    got = read(spark, [(None, 0, "message", 0, None, None), (1, None, None, None, "assistant", "x"), (1, None, None, None, "assistant", "x")])
    assert got == {None: ([("", "")], ""), 1: ([("assistant", "x"), ("assistant", "x")], "xx")}


def test_chat_query_equals_its_sql(spark, small):
    duck = duckdb.sql(queries.SQL["op1_chat_formatting"].replace("FROM conversations", f"FROM '{small}/conversations.parquet'")).fetchall()
    frame = queries.op1_chat_formatting(spark, small)
    assert sorted(map(tuple, frame.collect())) == sorted(duck)


def fitted(lengths, capacity):
    """Number of bins of best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def whole_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_query(spark, small):
    from tokenizers import Tokenizer

    rows = queries.op2_best_fit_packing(spark, small).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.add((d["doc_id"], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert len(rows) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert whole_packing(rows, 4096) == fitted([r["length"] for r in rows], 4096)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(int(rng.expovariate(1 / 20)) + 1, 64) for _ in range(400)] + [33] * 200 * (seed % 2)
    counts = {n: lengths.count(n) for n in set(lengths)}
    places = [(seq + i, at, n) for n, _, k, seq, at in packing.plan_best_fit(counts, 64) for i in range(k)]
    assert sorted(n for _, _, n in places) == sorted(lengths)
    assert whole_packing([{"sequence_id": s, "offset": o, "length": n} for s, o, n in places], 64) == fitted(lengths, 64)


def test_word_encoder_on_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = [" ", "\n", "\x01", "\t", "\xa0", "\u0301", "e\u0301", "It's", "don't!!", "<|endoftext|>", "\u3000", "漢字", "😀", "ABC", "12345", "\x00", "İ", "ß", "word", "x", "\u200b", "\ufeff"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)] + ["", None, "\x01", " \x01 "]
    monkeypatch.setattr(packing, "CACHE_WORDS", 900)
    monkeypatch.setattr(packing, "FRESH_WORDS", 100)
    encoder, tokenizer = packing.WordEncoder(path), Tokenizer.from_file(path)
    for i in range(0, len(texts), 250):
        part = texts[i : i + 250]
        ids, at = encoder.encode(*textops.flat(pa.array(part, pa.string())))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        bad = [t for k, t in enumerate(part) if ids[at[k] : at[k + 1]].tolist() != want[k]]
        assert not bad, bad[:3]


def test_packing_edge_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, None, 9, "x", 1, 1), (1, "", 9, "x", 1, 1), (None, "one two", 9, "x", 1, 1), (3, "word " * 50, 9, "x", 1, 1)] + [(4, "same text", 0, "", 0, 0)] * 40, DOCS)
    rows = packing.pack_documents(docs, path, 16).collect()
    assert whole_packing(rows, 16) and sum(r["doc_id"] == 4 for r in rows) == 40
    assert sorted(r["length"] for r in rows if r["doc_id"] == 1) == [1, 1] and [r["length"] for r in rows if r["doc_id"] is None] == [3]
    assert sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 3) == [(0, 0, 16), (1, 16, 16), (2, 32, 16), (3, 48, 3)]
    assert packing.pack_documents(docs.limit(0), path, 16).collect() == []


def library(texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [[*sp.encode(t or ""), sp.eos_id()] for t in texts]
    return [(i, sp.decode(i)) for i in ids]


def test_sentencepiece_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {
        (d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        for d, (ids, back) in zip(docs, library([d["text"] for d in docs]), strict=True)
    }
    rows = queries.op3_sentencepiece(spark, small).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(docs)


def test_sentencepiece_on_odd_texts(spark):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x00", "▁", "é", "é", "漢字", "😀", "﻿", "<s>", "</s>", "<unk>", "<0x41>", "aaaaaaa", "----", "==", "the", "Ing", "​", "\xa0", "1234567", "ﬁ", "\U000e0041"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", " ", "a" * 30000, "ab" * 9000, "- " * 5000]
    docs = spark.createDataFrame([(i if i % 50 else None, t, 0, "", 0, 0) for i, t in enumerate(texts)], DOCS).coalesce(1)
    rows = sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(texts)
    bad = [t for t, r, w in zip(texts, rows, library(texts), strict=True) if (r["ids"], r["decoded"]) != w]
    assert not bad, bad[:3]
    assert sentencepiece_bpe.encode_decode(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []
