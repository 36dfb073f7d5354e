"""Operator 4: token counts of a unigram model by dynamic programming over a trie of distinct pre-tokens.

A worker keeps one trie. Every node holds the best log probability of the string from the root to it and the number of pieces on that
best path (the forward score), computed once from its ancestors whatever number of words pass through it; a word's node stores its
count. Words are looked up afterwards. No row is shuffled.

A text is scored as it stands: the model's normalisation and its mark before the first word are not applied, so that a text that begins
without a space begins without the mark. Only the first LONG characters of a pre-token enter the trie; the scores of the rest need no
more than the last few before them and are not stored, so that a word of any length takes bounded memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table, texts

#: A pre-token: a run of other characters with at most one space before it, or one white-space character.
_PRETOKEN = re.compile(r" ?[^\s]+|\s")
#: Nodes and words that a worker's trie may hold before it starts anew; only time depends on it.
TRIE_NODES, KNOWN_WORDS = 400_000, 200_000
#: Characters of a pre-token in the trie; also the longest word whose count is remembered.
LONG = 256


class Unigram:
    """Pieces with log probabilities from a public sentencepiece file, which is not trained here.

    The file ranks its pieces and gives no probabilities, so that a piece of rank r has Zipf's: -ln(r + 1) - ln(sum of 1 / rank). A
    character without a piece counts as its UTF-8 bytes, each a byte piece with the least log probability.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        norm = math.log(sum(1 / (r + 1) for r in range(len(names))))
        self.score = {name: -math.log(r + 1) - norm for r, name in enumerate(names)}
        self.byte = -math.log(len(names) + 1) - norm
        self.longest = max(map(len, names))
        #: Reversed prefixes: whether any piece ends with these characters, so that a search backwards can end early.
        self.endings = {name[i:] for name in names for i in range(len(name))}


class Trie:
    def __init__(self, model: Unigram):
        self.model = model
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]
        self.known.clear()

    def insert(self, word: str) -> int:
        """The token count of a word; only nodes that no earlier word has made are computed."""
        model, children, best, count = self.model, self.children, self.best, self.count
        path, node = [0], 0
        for i, ch in enumerate(word[:LONG] if len(word) > LONG else word):
            after = children[node].get(ch)
            if after is None:
                n = len(ch.encode("utf-8", "surrogatepass"))
                top, pieces = best[node] + n * model.byte, count[node] + n
                for j in range(i, max(-1, i - model.longest), -1):
                    part = word[j : i + 1]
                    if part not in model.endings:
                        break
                    s = model.score.get(part)
                    if s is not None and ((t := best[path[j]] + s) > top or t == top and count[path[j]] + 1 < pieces):
                        top, pieces = t, count[path[j]] + 1
                after = len(best)
                children[node][ch] = after
                children.append({})
                best.append(top)
                count.append(pieces)
            node = after
            path.append(node)
        return count[node] if len(word) <= LONG else self._beyond(word, [best[p] for p in path], [count[p] for p in path])

    def _beyond(self, word: str, best: list[float], count: list[int]) -> int:
        """The token count from the scores and pieces of the prefixes up to LONG; of later ones the last few are kept."""
        model = self.model
        for i in range(LONG, len(word)):
            n = len(word[i].encode("utf-8", "surrogatepass"))
            top, pieces = best[-1] + n * model.byte, count[-1] + n
            for back in range(1, min(i + 1, model.longest) + 1):
                part = word[i + 1 - back : i + 1]
                if part not in model.endings:
                    break
                s = model.score.get(part)
                if s is not None and ((t := best[-back] + s) > top or t == top and count[-back] + 1 < pieces):
                    top, pieces = t, count[-back] + 1
            best.append(top)
            count.append(pieces)
            if len(best) > 2 * model.longest + LONG:
                del best[: -model.longest], count[: -model.longest]
        return count[-1]

    def counts(self, words: list[str]) -> int:
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(self.best) > TRIE_NODES or len(known) > KNOWN_WORDS:
                    self.clear()
                n = self.insert(w.replace(" ", "▁"))
                if len(w) <= LONG:
                    known[w] = n
            total += n
        return total


@lru_cache(maxsize=1)
def _trie(model_file: str) -> Trie:
    return Trie(Unigram(model_file))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text. Null and empty texts have none; repeated rows give repeated rows; ties between best paths go to the fewer pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_file)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                words, tokens = [], []
                for text in some.column(1).to_pylist():
                    found = _PRETOKEN.findall(text)
                    words.append(len(found))
                    tokens.append(trie.counts(found))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents."""
    import public_tokenizers as public

    return token_counts(table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))
