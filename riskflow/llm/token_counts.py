"""Token counts of texts under a unigram model, by dynamic programming that words with a common beginning share.

A text is split into pre-tokens by the public pattern of the vocabulary; a pre-token's segmentation is the one with
the highest sum of token scores (of equal sums, the one with the fewest tokens). Distinct pre-tokens form a trie over
their bytes: a node holds the forward score of its prefix, the number of tokens on the best path, and the vocabulary
entries that may still continue, so a prefix is scored once for all words that share it; the last node of a word
stores the word's count. The trie is walked depth first, in sorted order, and only the open path is kept.

The vocabulary is a file of token bytes and ranks. Its model is rank based: score(rank) = -log(rank + 2), Zipf's law;
every byte is a token, so every text has a segmentation (a byte that is missing costs `UNKNOWN`).

Rules: a null text has no tokens; repeated rows are counted each; other columns are ignored; an empty table gives an
empty result. No row is shuffled: a task keeps the counts of at most `KNOWN` words, and forgets them all when there
are more; long texts are read in runs of `RUN` pre-tokens, and pre-tokens of over `LONG` bytes keep no path.
"""

import base64
import math
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

KNOWN, RUN, LONG, UNKNOWN = 300_000, 100_000, 256, -100.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict:
    """The vocabulary's trie: byte -> node, and under -1 the score of the token that ends there."""
    root = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            node = root
            for b in base64.b64decode(token):
                node = node.setdefault(b, {})
            node[-1] = -math.log(int(rank) + 2)
    return root


def extended(root: dict, node: tuple, byte: int) -> tuple:
    """The node one byte further: (score, tokens, entries that may continue as (vocabulary node, score, tokens))."""
    score, tokens = node[0] + UNKNOWN, node[1] + 1
    open_entries = []
    for entry, before, count in (*node[2], (root, node[0], node[1])):
        entry = entry.get(byte)
        if entry is not None:
            open_entries.append((entry, before, count))
            own = entry.get(-1)
            if own is not None and (before + own > score or before + own == score and count + 1 < tokens):
                score, tokens = before + own, count + 1
    return score, tokens, open_entries


def counts(root: dict, words) -> dict:
    """Token count of each distinct word; one walk through the trie of all words."""
    found, path, last = {}, [(0.0, 0, ())], b""
    for data, word in sorted((w.encode(), w) for w in words):
        if len(data) > LONG:
            node = path[0]
            for b in data:
                node = extended(root, node, b)
            found[word] = node[1]
            continue
        same = 0
        for a, b in zip(last, data):
            if a != b:
                break
            same += 1
        del path[same + 1:]
        for b in data[same:]:
            path.append(extended(root, path[-1], b))
        found[word], last = path[-1][1], data
    return found


def _count(path, pattern):
    def run(batches):
        root, split, known = vocabulary(path), regex.compile(pattern), {}
        for batch in batches:
            pre, tokens, run = [0] * len(batch), [0] * len(batch), []

            def flush():
                nonlocal known
                if len(known) > KNOWN:
                    known = {}
                known |= counts(root, {w for _, words in run for w in words if w not in known})
                for row, words in run:
                    pre[row] += len(words)
                    tokens[row] += sum(map(known.__getitem__, words))
                run.clear()

            held = 0
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                found = (m[0] for m in split.finditer(text)) if text and len(text) > RUN else iter(split.findall(text or ""))
                while words := list(islice(found, RUN)):
                    run.append((row, words))
                    held += len(words)
                    if held >= RUN:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["key", "n_pretokens", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, key="doc_id", text="text") -> DataFrame:
    """`key`, n_pretokens and n_tokens of every row. `vocabulary_path` must lead to the file on every executor."""
    rows = docs.selectExpr(f"CAST(`{key}` AS BIGINT) key", f"CAST(`{text}` AS STRING) text")
    out = rows.mapInArrow(_count(vocabulary_path, pattern), "key long, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("key", key)
