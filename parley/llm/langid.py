"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is
cross-parsed against it: from the automaton's start, the longest match is one
phrase, and the next phrase begins at the first symbol that did not fit.  The
language that needs the fewest phrases per symbol, times the logarithm of its
training length, wins.

Texts become sequences of the UTF-8 bytes of lower-cased letters, whatever the script,
with one gap symbol between runs of letters, parsed in blocks of ``BLOCK`` symbols (a phrase ends at a block's end), so
that one long text is many short walks.  The automata are flattened to transition
tables in which a failed match restarts at the root, and all walks of a batch step
together.

Training text is bounded: ``TRAIN_SYMBOLS`` symbols per language, fewer where the
tables of many languages would exceed ``TABLE_STATES`` states in all, from texts of which
at most the first ``SAMPLE_CHARS`` characters are learned.  Every language with a
labelled text that has a letter there is learned.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is any
text when nothing was learned.  Ties go to the language first by code point.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_udf
from .kernels import CharTable, blocks

TRAIN_SYMBOLS = 48_000
TABLE_STATES = 600_000
#: Characters of a text that training looks at.
SAMPLE_CHARS = 20_000
BLOCK = 2048
#: A table of up to so many languages is broadcast, so that no text moves before it is picked; a larger one is joined.
BROADCAST_LANGS = 10_000


class Alphabet:
    """Symbols: 0 gap, 1 any byte of a letter that training did not have, then those it had."""

    def __init__(self, seen: bytes):
        self.size = 2 + len(seen)
        self.number = np.ones(256, dtype=np.uint8)
        self.number[np.frombuffer(seen, dtype=np.uint8)] = np.arange(2, self.size, dtype=np.uint8)
        self.number[32] = 0
        self.table: CharTable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in a row, and each text's number of symbols.  Runs of gaps are one."""
        self.table = self.table or CharTable(lambda c: int(c.isalpha()))
        data, size = letter_bytes(texts, self.table)
        return self.number[data], size


def letter_bytes(texts: list[str], table: CharTable) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the lower-cased letters of all texts, a blank for each run of others, and each text's number of them."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "replace"), dtype=np.uint32)
    size = np.array([len(t) for t in low], dtype=np.int64)
    owner = np.repeat(np.arange(len(low)), size)
    letter = table(code) != 0
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    kept = np.where(letter, code, 32)[keep].astype("<u4")
    width = 1 + (kept > 0x7F).astype(np.int64) + (kept > 0x7FF) + (kept > 0xFFFF)
    data = np.frombuffer(kept.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    return data, np.bincount(np.repeat(owner[keep], width), minlength=len(low))


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``seq``; state 0 starts."""
    go: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in seq:
        new = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


class Model:
    """Transition tables of all languages in one array."""

    def __init__(self, texts: dict[str, list[str]], symbols: int = TRAIN_SYMBOLS):
        self.langs = sorted(lang for lang, t in texts.items() if any(c.isalpha() for x in t for c in x))
        bound = min(symbols, max(64, TABLE_STATES // (2 * max(1, len(self.langs)))))
        table = CharTable(lambda c: int(c.isalpha()))
        learnt = {lang: letter_bytes(["\n".join(texts[lang])], table)[0][:bound] for lang in self.langs}
        seen = sorted({b for data in learnt.values() for b in np.unique(data).tolist()} - {32})
        self.alphabet = Alphabet(bytes(seen))
        width = self.alphabet.size
        tables, self.roots, self.cost = [], [], []
        base = 0
        for lang in self.langs:
            seq = self.alphabet.number[learnt[lang]].tolist()
            go = suffix_automaton(seq)
            # state * 4 + phrases that end: a failed symbol begins a new phrase, or is one if the root fails too
            table = np.full((len(go), width), 2, dtype=np.int32)
            table[0] = 1
            for c, q in go[0].items():
                table[:, c] = (q << 2) | 1
            for s, edges in enumerate(go):
                for c, q in edges.items():
                    table[s, c] = q << 2
            tables.append(table + (base << 2))
            self.roots.append(base)
            self.cost.append(np.log2(max(2, len(seq))))
            base += len(go)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and symbols per text."""
        code, size = self.alphabet.symbols(texts)
        count = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        pieces = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner):
            return count, size
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[owner] + k * BLOCK
        length = np.minimum(size[owner] - k * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        width = self.alphabet.size
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(owner), axis=1)
        ended = np.zeros(state.shape, dtype=np.int32)
        live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for step, n in enumerate(live.tolist()):
            x = self.table.take(state[:, :n] * np.int32(width) + code[start[:n] + step])
            ended[:, :n] += x & 3
            state[:, :n] = x >> 2
        ended += state != np.array(self.roots, dtype=np.int32)[:, None]  # the phrase that the block's end cut off
        for j in range(len(self.langs)):
            count[:, j] = np.bincount(owner, ended[j], len(texts))
        return count, size

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """The language and a score of each text: how clearly the best stands out, as a softmax of entropies in bits."""
        data = [t or "" for t in texts]
        langs, score = ["und"] * len(data), np.zeros(len(data))
        if not self.langs:
            return langs, score
        for lo, hi in blocks([4 * len(t) for t in data]):
            count, size = self.phrases(data[lo:hi])
            entropy = count * np.array(self.cost) / np.maximum(size, 1)[:, None]
            best = entropy.argmin(axis=1)
            weight = np.exp(-4 * (entropy - entropy.min(axis=1, keepdims=True)))
            sure = weight[np.arange(hi - lo), best] / weight.sum(axis=1)
            for i in range(hi - lo):
                if any(map(str.isalpha, data[lo + i])):
                    langs[lo + i], score[lo + i] = self.langs[best[i]], sure[i]
        return langs, score


def train(docs: DataFrame, fold: int = 5, held_out: int = 0, symbols: int = TRAIN_SYMBOLS) -> Model:
    """A model from the text and lang of documents outside the held-out fold.

    Of each language, a spread of texts that together hold about twice the symbols needed, and the first of them in any case.
    """
    text = F.substring("text", 1, SAMPLE_CHARS).alias("text")
    learn = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % fold != held_out)
    learn = learn.select("lang", text, F.xxhash64("doc_id", "text").alias("place")).where(F.regexp_like("text", F.lit(r"\p{L}")))
    place = F.pmod("place", F.lit(1 << 30))
    # of each language the share of its hash that holds 2.5 times the symbols, or up to its least hash
    some = learn.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min(place).alias("least"))
    some = some.select(F.col("lang").alias("lang_"), F.greatest(F.least(F.lit(1.0), 2.5 * symbols / F.col("n")) * (1 << 30), "least").alias("share")).collect()
    side = docs.sparkSession.createDataFrame([tuple(r) for r in some], "lang_ string, share double")
    some = F.broadcast(side) if len(some) <= BROADCAST_LANGS else side
    picked = learn.join(some, (F.col("lang") == F.col("lang_")) & (place <= F.col("share"))).select("lang", "place", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["place"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model(texts, symbols)


def identify(docs: DataFrame, model: Model, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TABLE_STATES

    def make():
        def fn(texts: list) -> dict:
            langs, score = shared.value.predict(texts)
            return {"lang_pred": langs, "score": score}

        return fn

    return docs.select(*keep, text_udf(make, "lang_pred string, score double")("text").alias("s")).select(*keep, "s.*")
