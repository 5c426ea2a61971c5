"""Token counts by a linear longest-match automaton.

A trie over a public vocabulary has, at each node, a failure link and the number of tokens that are popped when the link is
taken (both precomputed), so the greedy longest-match word-piece count of a word takes one step a character and builds no
pieces.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from jsonloom.llm.common import batches, claim, column, documents, small_batches, texts, worker_cache

MARK = "▁"
#: Words that a worker remembers, and how long they may be.
CACHE, CACHED = 400_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces; a mark at a piece's front stands for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton(dict):
    """Counts of words; a word's count is found when it is first asked for."""

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        final, chars, parent = [False], [""], [0]
        for piece in vocabulary:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                    chars.append(c)
                    parent.append(node)
                node = self.next[node][c]
            final[node] = True
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        level = list(self.next[0].values())
        for v in level:  # a first character that is no piece itself counts its bytes
            self.popped[v] = 1 if final[v] else len(chars[v].encode())
        while level:
            level = [w for v in level for w in self.next[v].values()]
            for v in level:
                if final[v]:
                    self.popped[v] = 1
                    continue
                z, n = parent[v], 0
                while True:
                    n, z = n + self.popped[z], self.fail[z]
                    if chars[v] in self.next[z]:
                        self.fail[v], self.popped[v] = self.next[z][chars[v]], n
                        break
                    if not z:  # no piece goes on with it: its bytes
                        self.fail[v], self.popped[v] = 0, n + len(chars[v].encode())
                        break

    def count(self, text: str) -> int:
        """Tokens of the greedy longest match from the left; a character that no piece begins with counts its bytes."""
        node, n, steps, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in text:
            while c not in steps[node] and node:
                n, node = n + popped[node], fail[node]
            if c in steps[node]:
                node = steps[node][c]
            else:
                n += len(c.encode("utf-8", "surrogatepass"))
        while node:
            n, node = n + popped[node], fail[node]
        return n

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(word) <= CACHED:
            if len(self) > CACHE:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(pieces(path))


worker_cache(automaton.cache_clear)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words (runs without white space) and n_tokens of each row; null and empty texts have 0 of both."""
    path, kind = path or default_vocabulary(), docs.schema["doc_id"].dataType.simpleString()

    def each(found):
        claim("tokencount")
        counts = automaton(path)
        for b in found:
            words = [(x or b"").decode("utf-8", "replace").split() for x in column(b, "body")]
            schema = pa.schema([b.schema.field("doc_id"), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
            yield from batches(schema, [[b.column("doc_id"), [len(w) for w in words], [sum(map(counts.__getitem__, w)) for w in words]]])

    return texts(docs, "doc_id").mapInArrow(each, f"doc_id {kind}, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each row; repeated rows each for itself, null doc_ids like others, no rows of none."""
    small_batches(spark)
    return token_counts(documents(spark, sf_dir))
