"""Alignment of two tokenizers against a brute-force version."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from barline.llm.alignment import align, cuts
from barline.llm.queries import PIECES, QUERIES, RANKS, TOKENIZER
from tests.llm.helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def gpt_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def brute(rows):
    """Spans of both tokenizers, walked token by token."""
    a_tok, b_tok, letters = Tokenizer.from_file(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECES), gpt_letters()
    a_tok.encode_special_tokens = True
    done, count, most = [], Counter(), Counter()
    for d, t in rows:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_raw = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        names = [b_tok.id_to_piece(i) for i in b]
        b_raw = [bytes([int(n[3:5], 16)]) if n.startswith("<0x") and len(n) == 6 else n.replace("▁", " ").encode() for n in names]
        if not t or not b"".join(a_raw) == b"".join(b_raw) == (" " + t).encode():
            done.append((d, None))
            continue
        i = j = p = q = 0
        links, groups, start_a, start_b = [], [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            p_end, q_end = p + len(a_raw[i]), q + len(b_raw[j])
            if p_end <= q_end:
                p, i = p_end, i + 1
            if q_end <= p_end:
                q, j = q_end, j + 1
            if p == q:
                groups.append(",".join(map(str, a[start_a:i])) + "|" + ",".join(map(str, b[start_b:j])))
                start_a, start_b = i, j
        count.update(links)
        done.append((d, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return Counter(
        (d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, x[0], x[1], x[2], len(x[3]), sum(count[k] == most[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]) for d, x in done
    )


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


HARD = [
    (60, " a  b "), (61, "▁ space sign"), (62, "<|endoftext|> <s> </s> <unk> <0x41>"), (63, "x\n y\n  z\n \ty   q　w"), (64, "don't  stop 's it's 12,5 € 3.14"), (65, "日本語テキスト" * 40), (66, " "), (67, "a" * 500),
    (68, "ends with space "), (69, "two  "), (70, "\u0000\u001f\u0085 x"), (71, "ﬁ ½ Ⅷ é é"), (72, "🙂🙂 ok"), (73, "runs on \n "), (74, "and on\n\n"), (75, "ok  "),
]


def test_odd_texts_and_chunks_of_any_size(spark):
    docs, rows = odd_docs(spark)
    rows = [r[:2] for r in rows] + HARD
    docs = docs.unionByName(spark.createDataFrame([(*h, "x") for h in HARD], "doc_id long, text string, chunk string"), allowMissingColumns=True)
    want = brute(rows)
    assert rows_of(align(docs, TOKENIZER, PIECES, RANKS)) == want
    assert rows_of(align(docs.repartition(3), TOKENIZER, PIECES, None, chunk_links=1)) == want
    assert align(no_docs(spark), TOKENIZER, PIECES, RANKS).count() == 0


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_alignment"](spark, SF)) == brute(rows)


def test_cuts_are_the_common_ends():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.02, 0.5, 1.0):
        size = rng.integers(1, 3000, 7)
        last = np.cumsum(size)
        a = np.unique(np.concatenate([np.flatnonzero(rng.random(last[-1]) < 0.4) + 1, last]))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < share], np.setdiff1d(np.flatnonzero(rng.random(last[-1]) < 0.3) + 1, a), last]))
        assert (cuts(a, b, np.searchsorted(a, last)) == np.isin(a, b)).all()
