"""Packing against the tokenizer itself, and what sequences must be."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import packing

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(str(PATH))


def proven(rows, docs, tokenizer, length):
    """Check every piece against the documents' own ids; the tokens of padding."""
    ids, own, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert own.keys() == ids.keys()
    for doc_id, pieces in own.items():
        assert len({tuple(t) for t in ids[doc_id]}) == 1 or doc_id is None
        if doc_id is None:
            continue
        tokens, copies = ids[doc_id][0], len(ids[doc_id])
        cover = np.zeros(len(tokens), int)
        for p in pieces:
            assert p.doc_tokens == len(tokens) and 0 < p.length <= length
            part = tokens[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            cover[p.start : p.start + p.length] += 1
        assert (cover == copies).all()
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


@pytest.mark.parametrize("length, group", [(64, 500), (4096, 1 << 21), (16, 1)])
def test_every_id_lies_in_one_piece(spark, docs, texts, tokenizer, length, group):
    found = packing.packed(docs, str(PATH), length=length, group_tokens=group).collect()
    assert proven(found, texts, tokenizer, length) == 0


def test_an_empty_table(spark, no_docs):
    assert packing.packed(no_docs, str(PATH)).count() == 0


def test_ids_equal_the_tokenizer_on_odd_texts(tokenizer):
    odd = [None, "", " ", "It's we'll THEY'RE 'S", "3.14 a1b2 x--y ...!", "École  école İı ß ŉ ́ ̈́", " a b\u0085c　d",
           "tab\there\r\nand\x0bthere\x0c", "\x1c\x1d x\x1fy", "नमस्ते 你好 🙂👩‍👩‍👧", "<|endoftext|> x<|startoftext|>", "ΑΣ ΣΑΣ", "a" * 5000]
    for first, flat, bounds in packing.token_rows(pa.array(odd), str(PATH), 2):
        for r in range(len(bounds) - 1):
            assert flat[bounds[r] : bounds[r + 1]].tolist() == tokenizer.encode(odd[first + r] or "", add_special_tokens=False).ids + [2]
    assert packing.encoder(str(PATH)).checked


def test_units_are_forgotten_when_memory_is_full(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    known = packing.UnitIds(str(PATH))
    for text in ("one two three", "one four FIVE six", "seven", "a b c d e f g h i", "x1y2, it's"):
        assert known.of_text(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(known.hashes) <= 9


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 2.,'-|<>sltvemr\té×÷ÀßÞÿıİ\u0301\u0130\u00a0\x1c\x00²½ªж你🙂ſ\u2028", max_size=40))
def test_any_text_is_encoded_as_a_whole(tokenizer, text):
    first, flat, bounds = next(packing.token_rows(pa.array([text, None]), str(PATH), 2))
    assert flat.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2, 2]


def plain_first_fit(sizes, length):
    bins = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b in bins:
            if sum(sizes[i] for i in b) + sizes[item] <= length:
                b.append(item)
                break
        else:
            bins.append([item])
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_the_tournament_tree_is_first_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, rng.choice((10, 60, 100))) for _ in range(rng.randrange(0, 200))]
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), 100) == plain_first_fit(sizes, 100)


@pytest.mark.parametrize("sizes", [[], [1], [63], [33] * 50, [40] * 7, [1] * 1000, [63, 63, 63, 1], [32, 32], list(range(1, 64)) * 3])
def test_filled_bins(sizes):
    bins = packing.filled(np.array(sizes, np.int64), 64)
    used = defaultdict(list)
    for b in bins:
        total = sum(n for _, _, n in b)
        assert total == 64 or total & (total - 1) == 0
        for item, first, n in b:
            used[item].append((first, n))
    assert sum(len(b) for b in bins) <= len(sizes) + len(bins)  # a cut for each bin at most
    for i, size in enumerate(sizes):
        at = 0
        for first, n in sorted(used[i]):
            assert first == at
            at += n
        assert at == size
    assert sum(sum(n for _, _, n in b) < 64 for b in bins) <= 6
