"""Token counts by prefix dynamic programming: the exact count of every prefix, so budgets need no new encoding.

For each prefix of a word there is one token that its merges end with: the vocabulary's token that ends
there and stays apart from the last token of what stands before it. So the last token and the count of a
prefix follow from those of shorter prefixes, with and without the mark for a word's end.

A chunk of text (a run without ASCII white space, or a special token) is stored with the counts of all its
prefixes; a text's count at a prefix is the sum over the chunks before and the stored count within the chunk.
The number of tokens is the last of them, and a budget is answered by a search in them: nothing is encoded again.
Only where a prefix is no prefix of the normalised text (it ends before a combining mark, or inside a special
token) its last words are counted by themselves.

Defined cases: null text is empty and has no tokens; a special token's string in a text counts as one token,
as in the tokenizers library, and a part of it as plain text; texts are handled whole, in runs of about 2 MB (a longer
text is a run of its own); counts may fall from one prefix to the next, so of several prefixes within a budget the
longest is taken; other columns are ignored, whatever their names; rows that share a doc_id, and repeated rows, each
give a row; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textops
from .bpe import WORDS, Merges, symbol_sums, symbol_values
from .chunks import ChunkTable, Ragged, cut, places
from .common import prepare, texts, worker_state


#: Symbols of words that are counted many at a time.
_SHORT = 16


def _contraction(word: str) -> bool:
    return word[0] == "'" and len(word) > 1 and word[1].isalpha()


def _lower(text: str) -> str:
    """Lowered character by character, so without the final form of sigma."""
    return text.replace("\u03a3", "\u03c3").lower()


class PrefixCounter:
    """Counts for files whose words end with a mark, whose texts are composed and lowered, and whose white space is dropped."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.special = self.merges.special
        self.specials = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words: dict[str, list[int]] = {}
        self.table = ChunkTable(self._values, Ragged(np.int32))

    def _inner(self, s: str, n: int) -> tuple[list[int], list[int]]:
        """For each prefix of s up to n symbols, without the end mark: its last token and its number of tokens."""
        known, lengths, apart = self.merges.known.get, self.merges.lengths_at_end.get, self.merges.stay_apart
        last, inner = [-1], [0]
        for i in range(1, n + 1):
            for k in lengths(s[max(0, i - 3) : i], (2, 1)):
                if k <= i and (t := known(s[i - k : i])) is not None and (k == i or apart(last[i - k], t)):
                    last.append(t)
                    inner.append(inner[i - k] + 1)
                    break
            else:
                raise ValueError(f"no token ends at {i} in {s!r}")
        return last, inner

    def _ended(self, s: str, i: int, last: list[int], inner: list[int]) -> int:
        """Tokens of the first i symbols as a word of its own, with the end mark."""
        known, apart, end = self.merges.known.get, self.merges.stay_apart, chr(ord(s[i - 1]) + 0x100)
        for k in self.merges.lengths_at_end.get(s[max(0, i - 3) : i - 1] + end, (2, 1)):
            if k <= i and (t := known(s[i - k : i - 1] + end)) is not None and (k == i or apart(last[i - k], t)):
                return inner[i - k] + 1
        raise ValueError(f"no token ends at {i} in {s!r}")

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word's bytes, 0 to all, as a word of its own."""
        s = word.encode().decode("latin-1")
        last, inner = self._inner(s, len(s) - 1)
        return [0, *(self._ended(s, i, last, inner) for i in range(1, len(s) + 1))]

    def counts_of_all(self, words: list[str]) -> list[list[int]]:
        """prefix_counts without the first of many words (as symbols), all words a symbol further at each step."""
        m = self.merges
        codes, sums, ends = symbol_sums(words)
        size = np.diff(ends, prepend=0)
        begin, width = ends - size, int(size.max(initial=0)) + 1
        more = symbol_values(codes + np.uint16(0x100)) - symbol_values(codes)
        last, inner, out = np.full((len(words), width), -1, np.int64), np.zeros((len(words), width), np.int64), np.zeros((len(words), width), np.int64)
        for i in range(1, width):
            for rows, ended in ((np.flatnonzero(size > i), False), (np.flatnonzero(size >= i), True)):
                if not len(rows):
                    continue
                at = begin[rows] + i
                hashes = (lambda a, z: textops.changed_hashes(sums, a, z, more[z - 1])) if ended else (lambda a, z: textops.span_hashes(sums, a, z))
                most = np.minimum(m.longest_at_end.find(hashes(np.maximum(at - 3, begin[rows]), at), 2), i)
                open_ = np.ones(len(rows), bool)
                for k in range(int(most.max()), 0, -1):
                    j = np.flatnonzero(open_ & (most >= k))
                    t = m.tokens.find(hashes(at[j] - k, at[j]), -1)
                    j, t = j[t >= 0], t[t >= 0]
                    if k < i:
                        good = m.apart(last[rows[j], i - k], t)
                        j, t = j[good], t[good]
                    if ended:
                        out[rows[j], i] = inner[rows[j], i - k] + 1
                    else:
                        last[rows[j], i], inner[rows[j], i] = t, inner[rows[j], i - k] + 1
                    open_[j] = False
                if open_.any():
                    raise ValueError(f"no token ends at {i} in {words[int(rows[open_][0])]!r}")
        return [x[1 : n + 1] for x, n in zip(out.tolist(), size.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Work the prefix counts of new words out together."""
        new = [w for w in dict.fromkeys(words) if w not in self.words and not _contraction(w)]
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
        symbols = [w.encode("utf-8", "surrogatepass").decode("latin-1") for w in new]
        short = [i for i, x in enumerate(symbols) if len(x) <= _SHORT]
        for i, counts in zip(short, self.counts_of_all([symbols[i] for i in short]), strict=True):
            self.words[new[i]] = counts if new[i].isascii() else [counts[k - 1] for k in np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in new[i]]).tolist()]

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, 1 to all its characters, remembered."""
        if (got := self.words.get(word)) is None:
            own = self.prefix_counts(word)
            if word.isascii():
                got = own[1:]
            else:
                at, got = 0, []
                for c in word:
                    at += len(c.encode("utf-8", "surrogatepass"))
                    got.append(own[at])
            if _contraction(word):  # parts of it are words of their own
                got[:-1] = [sum(self.word_prefixes(c)[-1] for c in word[:i]) for i in range(1, len(word))]
            if len(self.words) > WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def _lowered_prefixes(self, low: str) -> tuple[list[int], list[int]]:
        """Tokens of each prefix of a normalised text without special tokens, 0 to all; and where its words start."""
        out, base, starts = [0], 0, []
        for m in self.split.finditer(low):
            out += [base] * (m.start() + 1 - len(out))
            starts.append(m.start())
            own = self.word_prefixes(m.group())
            out += [base + n for n in own]
            base = out[-1]
        return out + [base] * (len(low) + 1 - len(out)), starts

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a text without special tokens, 1 to all its characters."""
        if chunk.isascii():
            low = chunk.lower()
            return self.word_prefixes(low) if low.isalpha() else self._lowered_prefixes(low)[0][1:]
        if unicodedata.is_normalized("NFC", chunk):  # then its prefixes are, too
            parts = [_lower(c) for c in chunk]
            counts = self._lowered_prefixes("".join(parts))[0]
            return [counts[i] for i in np.cumsum([len(x) for x in parts]).tolist()]
        return self._composed_prefixes(chunk)

    def _composed_prefixes(self, chunk: str) -> list[int]:
        """The same where characters combine. A prefix that ends within such a group has other characters at its end than
        the normalised text; its words from three characters before on are counted by themselves."""
        groups: list[str] = []
        for c in chunk:
            alone = groups and not unicodedata.combining(c) and unicodedata.normalize("NFC", groups[-1] + c) == unicodedata.normalize("NFC", groups[-1]) + unicodedata.normalize("NFC", c)
            if groups and not alone:
                groups[-1] += c
            else:
                groups.append(c)
        parts = [_lower(unicodedata.normalize("NFC", g)) for g in groups]
        low = "".join(parts)
        counts, starts = self._lowered_prefixes(low)
        out, at = [], 0
        for g, p in zip(groups, parts, strict=True):
            for i in range(1, len(g)):
                k = int(np.searchsorted(starts, at - 3, "right")) - 1
                w = starts[k] if k >= 0 else 0
                out.append(counts[w] + self._lowered_prefixes(low[w:at] + _lower(unicodedata.normalize("NFC", g[:i])))[0][-1])
            at += len(p)
            out.append(counts[at])
        return out

    def _values(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lowered = [_lower(unicodedata.normalize("NFC", c)) for c in chunks]
        self._learn([w for x in lowered for w in ([x] if x.isascii() and x.isalpha() else self.split.findall(x))])
        # of a special token the parts are plain text, which is right where none stands before it; _special mends the rest
        counts = [self.chunk_prefixes(c) if c not in self.special else [*self.chunk_prefixes(c)[:-1], 1] for c in chunks]
        return np.fromiter((n for c in counts for n in c), np.int32), np.fromiter(map(len, counts), np.int64, len(counts))

    def chunks(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The chunks of a run of texts: start, end, chunks before each row, the table's row, tokens before each chunk (chunks + 1)."""
        start, end, at = cut(raw, ends, False, self.specials)
        rows = self.table.rows(raw, start, end)
        store = self.table.store
        return start, end, at, rows, np.concatenate(([0], np.cumsum(store.flat[store.start[rows] + store.size[rows] - 1], dtype=np.int64)))

    def _special(self, raw: np.ndarray, low: int, start: np.ndarray, end: np.ndarray, before: np.ndarray, c: int) -> list[int] | None:
        """If chunk c is a special token right behind other text, the text's tokens at each prefix of it; low: the row's first chunk."""
        name = raw[start[c] : end[c]].tobytes().decode("utf-8", "surrogatepass")
        if name not in self.special or c == low or end[c - 1] != start[c]:
            return None
        text = raw[start[c - 1] : end[c - 1]].tobytes().decode("utf-8", "surrogatepass")
        if text in self.special:
            return None
        own = self.chunk_prefixes(text + name)[len(text) :]
        return [int(before[c - 1] - before[low]) + n for n in own[:-1]] + [int(before[c + 1] - before[low])]

    def count_run(self, raw: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each row, and the characters of its longest prefix that has at most budget tokens."""
        start, end, at, rows, before = self.chunks(raw, ends)
        n = before[at[1:]] - before[at[:-1]]
        letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        fit = letters[ends[1:]] - letters[ends[:-1]]
        store = self.table.store
        for r in np.flatnonzero(n > budget).tolist():
            low, high = int(at[r]), int(at[r + 1])
            c = low + int(np.searchsorted(before[low:high] - before[low], budget, "right")) - 1
            own = self._special(raw, low, start, end, before, c)
            if own is None:
                own = store.flat[store.start[rows[c]] : store.start[rows[c]] + store.size[rows[c]]] + (before[c] - before[low])
            inside = np.flatnonzero(np.array(own) <= budget)
            fit[r] = letters[start[c]] - letters[ends[r]] + (inside[-1] + 1 if len(inside) else 0)
        return n, fit

    def prefixes_run(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of every prefix of each row, 0 to all its characters, and where each row's begin (rows + 1 numbers)."""
        start, end, at, rows, before = self.chunks(raw, ends)
        letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        cuts = letters[ends] + np.arange(len(ends))  # a row has a number more than characters
        row = np.repeat(np.arange(len(ends) - 1), np.diff(at))
        first = before[at[row]] if len(row) else before[:0]
        out = np.zeros(int(cuts[-1]), np.int64)
        place = letters[start] + row + 1
        own, size = self.table.store.take(rows)
        whole = np.diff(before)
        np.add.at(out, place + size - 1, whole)
        total = np.concatenate(([0], np.cumsum(out)))
        out = total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts))  # tokens of the chunks that end before
        out[places(place, size)] = own + np.repeat(before[:-1] - first, size)
        for c in np.flatnonzero(start[1:] == end[:-1]) + 1 if len(start) else ():
            if (mended := self._special(raw, int(at[row[c]]), start, end, before, int(c))) is not None:
                out[place[c] : place[c] + len(mended)] = mended
        return out, cuts

    def _run(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [t.encode("utf-8", "surrogatepass") for t in texts_]
        return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, data)), dtype=np.int64)))

    def count(self, text: str) -> int:
        return int(self.count_run(*self._run([text]), 1 << 62)[0][0])

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most budget tokens."""
        return int(self.count_run(*self._run([text]), budget)[1][0])

    def text_prefixes(self, text: str) -> list[int]:
        """Tokens of every prefix of a text, 0 to all its characters."""
        return self.prefixes_run(*self._run([text]))[0].tolist()


def counter(path: str) -> PrefixCounter:
    """The counter of a file, once a Python worker."""
    return worker_state(("counts", path), lambda: PrefixCounter(path))


def _counts(batches: Iterator[pa.RecordBatch], path: str, budget: int) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    for b in batches:
        for row, last, raw, ends in textops.slices(b.column("text")):
            n, fit = c.count_run(raw, ends, budget)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, last - row), pa.array(np.diff(ends), pa.int64()), pa.array(n, pa.int64()), pa.array(n > budget, pa.bool_()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])


def count(docs: DataFrame, path: str, budget: int = 2048) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit, fit_chars); fit_chars: characters to keep for the budget."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _counts(it, path, budget), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefixes(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, prefix_tokens): tokens of every prefix of each text, by its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for row, last, raw, ends in textops.slices(b.column("text")):
                counts, cuts = c.prefixes_run(raw, ends)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, last - row), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(counts, pa.int32()))], ["doc_id", "prefix_tokens"])

    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, prefix_tokens array<int>")


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """docs with each text cut to its longest prefix within the budget; a null text stays null. Other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            text = b.column("text")
            fit = np.concatenate([np.zeros(0, np.int64), *(c.count_run(raw, ends, budget)[1] for _, _, raw, ends in textops.slices(text))])
            cut_ = pa.array([None if t is None else t[:k] for t, k in zip(text.to_pylist(), fit.tolist(), strict=True)], text.type)
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), cut_)

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
