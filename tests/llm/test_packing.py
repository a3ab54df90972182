import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm.packing import cuts, encoder, pack_documents, plan_patterns
from tests.llm import cases

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
FAST, SLOW = encoder(JSON, RANKS), encoder(JSON)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" \n\t\r\x0b\x0c\x1c\x85\xa0 　a'sB1é.<|>endoftext", max_size=60)))
def test_fast_ids_equal_the_tokenizer_file(text):
    assert FAST(text).tolist() == SLOW(text).tolist()


def test_special_token_string():
    assert SLOW("a<|endoftext|>b").tolist() == FAST("a<|endoftext|>b").tolist()


def test_other_ranks_are_refused(tmp_path):
    lines = open(RANKS, "rb").read().splitlines()
    lines[300], lines[301] = lines[300].split()[0] + b" 301", lines[301].split()[0] + b" 300"
    (tmp_path / "x.tiktoken").write_bytes(b"\n".join(lines))
    with pytest.raises(ValueError):
        encoder(JSON, str(tmp_path / "x.tiktoken"))


def test_ids_of_a_whole_table_are_the_tokenizer_file_s():
    texts = [t or "" for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text]
    for text, want in zip(texts, Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)):
        assert FAST(text).tolist() == want.ids


def test_pieces_and_places(spark, tmp_path):
    rows = cases.rows(80)
    got = pack_documents(cases.stored(spark, tmp_path / "d", rows).repartition(5), JSON, RANKS).collect()
    tok = Tokenizer.from_file(JSON)
    want = Counter()
    total = 0
    for d, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        for k, (s, n) in enumerate(cuts(len(ids))):
            want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= -(-total // 1024) + 2


def test_plan_uses_everything_and_few_sequences():
    rng = random.Random(2)
    for _ in range(30):
        counts = Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 60), 1024]) for _ in range(rng.randint(1, 3000)))
        plan = plan_patterns(dict(counts))
        back = Counter()
        for p, k in plan:
            assert sum(p) <= 1024 and k > 0
            for n in p:
                back[n] += k
        assert back == counts
        bound = max(-(-sum(n * c for n, c in counts.items()) // 1024), sum(c for n, c in counts.items() if n > 512))
        assert sum(k for _, k in plan) <= bound * 1.03 + 1


def test_empty_table(spark, tmp_path):
    assert pack_documents(cases.stored(spark, tmp_path / "d", []), JSON, RANKS).count() == 0
