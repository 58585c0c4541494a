import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hilbertine.llm import packing

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, want, width):
    tokenizer, by_doc, by_seq = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in want.items():
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert [r.length for r in got] == [len(ids[i : i + width]) for i in range(0, len(ids), width)]
        for r in got:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
    return len(by_seq)


def test_texts_of_added_tokens_are_what_the_tokenizer_makes_of_them(spark):
    texts = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext|", "plain words"]
    rows = packing.pack_documents(docs(spark, texts), PATH).collect()
    check(rows, dict(enumerate(texts)), 2048)


def test_pieces_and_sequences(spark):
    rng = random.Random(1)
    vocabulary = ["Tree", "naïve", "don't", "x1y", "12,5", "…", "straße", "éa", "́b", "ΑΣ", "日本語", "a\tb", "\x1c", " c"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 300]))) + rng.choice(["", "\n", " \n x"]) for _ in range(120)]
    rows = packing.pack_documents(docs(spark, texts), PATH, 64).collect()
    total = sum(r.length for r in rows)
    assert check(rows, dict(enumerate(texts)), 64) <= total / 64 * 1.06 + 1


def test_tree_of_many_tasks_stays_close_to_the_bound(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.randint(1, 100), 0, i) for i in range(6000)]
    pieces = spark.createDataFrame(rows, packing.PIECE_SCHEMA)
    got = packing.pack_pieces(pieces, 100, fan_in=3, pieces_per_task=150).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000))
    alone = len(packing.best_fit(np.array([r[3] for r in rows]), 100)[2])
    assert len({r.sequence_id for r in got}) <= alone * 1.05  # tasks of 150 pieces; production tasks hold 32,768


def test_only_bins_that_can_be_filled_go_up():
    up = packing._going_up(np.array([60] * 50 + [30]), 100, 2, 4)
    assert up.sum() == 5 and up[50]


def test_edges(spark):
    rows = packing.pack_documents(edges(spark), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows)[:3] == [(0, 5), (1, 1), (2, 1)]
    assert len(rows) == 8 and len({(r.sequence_id, r.offset) for r in rows}) == 8
    assert packing.pack_documents(none(spark), PATH).count() == 0
