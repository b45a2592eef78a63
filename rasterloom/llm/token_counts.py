"""Token counts without encoding: dynamic programming shared over a trie of the distinct pre-tokens.

Distinct pre-tokens are inserted in a trie that lives as long as its worker. Each node (a prefix) holds the best
unigram score of the prefix and the number of tokens on that path, which are computed when the node is made: once for
each shared prefix, whatever word or batch brought it. The counts at terminals are stored, and a document's count is a
sum over its pre-tokens. Rules and vocabulary are those of the encoder, so the count is the length of its ids.

Cases: null and empty texts have no pre-token and no token; a long pre-token (a text without spaces) is cut where no
piece reaches across, which changes no count; above NODES nodes the trie begins anew; repeated rows give a row each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pieces, texts_of
from rasterloom.llm.vocab import SPACE, VOCAB_PATH, Vocab, Words, load, split_spaces, vocab_of


#: A trie of so many nodes (some 200 bytes each) is begun anew before the next batch.
NODES = 1 << 19
#: Characters of a word that are inserted; counts of what follows are carried along.
DEEP = 1 << 12


class Trie:
    """Prefixes of pre-tokens, with the score and the token count of the best path to each."""

    def __init__(self, v: Vocab):
        self.v, self.scores = v, v.scores.tolist()
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Tokens of the best segmentation of a word, whose first DEEP characters are inserted."""
        get, reach, scores, child, best, count = self.v.ids.get, self.v.reach.get, self.scores, self.child, self.best, self.count
        node, path = 0, [0]
        for j, c in enumerate(word if len(word) <= DEEP else word[:DEEP], 1):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                top, n, known = float("-inf"), 0, False
                for size in range(min(j, reach(c, 0)), 0, -1):
                    i = get(word[j - size : j])
                    if i is not None:
                        known = known or size == 1
                        before = path[j - size]
                        if (s := best[before] + scores[i]) > top:
                            top, n = s, count[before] + 1
                if not known and (s := best[path[j - 1]] + self.v.unk_score) > top:
                    top, n = s, count[path[j - 1]] + len(c.encode())
                node = child[key] = len(best)
                best.append(top)
                count.append(n)
            path.append(node)
        return count[node] if len(word) <= DEEP else self._rest(word, [(best[k], count[k]) for k in path[-self.v.longest :]])

    def _rest(self, word: str, last: list[tuple[float, int]]) -> int:
        """The same for what follows the inserted beginning, which hardly any other word shares: the last places' scores and
        counts are carried along."""
        get, reach, scores = self.v.ids.get, self.v.reach.get, self.scores
        for j in range(DEEP + 1, len(word) + 1):
            c, top, n, known = word[j - 1], float("-inf"), 0, False
            for size in range(min(j, reach(c, 0)), 0, -1):
                i = get(word[j - size : j])
                if i is not None:
                    known = known or size == 1
                    if (s := last[-size][0] + scores[i]) > top:
                        top, n = s, last[-size][1] + 1
            if not known and (s := last[-1][0] + self.v.unk_score) > top:
                top, n = s, last[-1][1] + len(c.encode())
            last.append((top, n))
            if len(last) > 4096:
                del last[: -self.v.longest]
        return last[-1][1]

    def counts(self, words: list[str]) -> np.ndarray:
        parts, owner = self.v.parts(words)
        return np.bincount(owner, [self.tokens(w) for w in parts], len(words)).astype(np.int64)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens."""
    model = docs.sparkSession.sparkContext.broadcast(load(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words, counts = Trie(vocab_of(model.value)), Words(), np.zeros(0, np.int64)
        for batch in pieces(batches, "text"):
            texts = texts_of(batch, "text")
            if words.begin():
                counts = counts[:0]
            if len(trie.best) > NODES:
                trie.clear()
            places, offsets, new = words.of(texts, split_spaces)
            counts = np.concatenate([counts, trie.counts([SPACE + w.replace(" ", SPACE) for w in new])])
            total = np.concatenate([[0], np.cumsum(counts[places])])[offsets]
            yield pa.record_batch([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(np.diff(offsets)), pa.array(np.diff(total))], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long")
