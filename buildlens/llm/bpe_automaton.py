"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton over tokens follows from the merges: every merge (a, b) -> c is a gadget that
adds c wherever a was allowed, lets c be followed by what b could be followed by, and deletes
the arc b after a. Whether token t may follow token p is therefore settled by unwinding the
gadgets in reverse order of rank (``Merges.follows``); a token sequence is the encoding of
its word exactly when each token may follow the one before it.

``WordAutomaton`` finds the path whose arcs spell a word. Just one path spells a prefix, as a
prefix has one encoding; so a place of the word from which the end cannot be reached is never
entered again, and a word takes steps in proportion to its length. The tokens are the path's arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from buildlens.llm.shared import give_back, in_parts, kept, map_arrow, small_batches, whole

#: Words that a Python worker remembers, and answers of the merges that it keeps: bounds of its
#: memory, none of which changes a result.
MEMO = 160_000
ANSWERS = 100_000
#: Below this character no version of Unicode since 7.0 has changed classes, case or marks.
SETTLED = "\u0530"
#: More than the ids: two tokens make one number.
IDS = 1 << 24
#: Bytes of a token's beginning by which its possible lengths are looked up.
HEAD = 4


def byte_symbols() -> list[str]:
    """The printable stand-in for every byte value, as byte-level BPE writes them."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks and parts of the merged tokens."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (vocab[a], vocab[b])
            c = vocab[a + b]
            self.rank.setdefault(pair, r)
            if c not in self.parts:
                self.parts[c] = pair
                self.made[c] = r
        self.memo: dict[int, bool] = {}

    def follows(self, p: int, t: int) -> bool:
        """Whether an arc t leaves the state that p enters, after all gadgets."""
        key = p * IDS + t
        if (got := self.memo.get(key)) is not None:
            return got
        until = len(self.rank) + 1
        ok = True
        while True:
            r = self.rank.get((p, t))
            if r is not None and r < until:
                ok = False
                break
            rp, rt = self.made.get(p, -1), self.made.get(t, -1)
            if rp < 0 and rt < 0:
                break
            if rt >= rp:
                until, t = rt + 1, self.parts[t][0]
            else:
                until, p = rp, self.parts[p][1]
        if len(self.memo) > ANSWERS:
            self.memo.clear()
        self.memo[key] = ok
        return ok


class WordAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.merges = Merges(vocab, merges)
        symbols = byte_symbols()
        first = {vocab[s]: bytes([b]) for b, s in enumerate(symbols)}
        last = {vocab[s + end]: bytes([b]) for b, s in enumerate(symbols)}
        spelled = first | last

        def spell(t: int) -> bytes:
            if t not in spelled:
                spelled[t] = b"".join(map(spell, self.merges.parts[t]))
            return spelled[t]

        def ends(t: int) -> bool:
            while t in self.merges.parts:
                t = self.merges.parts[t][1]
            return t in last

        for t in self.merges.parts:
            spell(t)
        #: Tokens by what they spell: those within a word, and those with the end mark.
        self.inner = {w: t for t, w in spelled.items() if not ends(t)}
        self.final = {w: t for t, w in spelled.items() if ends(t)}
        #: Lengths of tokens, longest first, by the bytes with which they begin.
        sizes: dict[bytes, set[int]] = {}
        for w in spelled.values():
            sizes.setdefault(w[:HEAD], set()).add(len(w))
        for w in sizes:
            sizes[w] = sizes[w].union(*(sizes.get(w[:k], ()) for k in range(1, len(w))))
        self.sizes = {w: tuple(sorted(found, reverse=True)) for w, found in sizes.items()}

    def lengths(self, head: bytes) -> tuple[int, ...]:
        """The lengths that a token which begins like ``head`` can have."""
        while head not in self.sizes:
            head = head[:-1]
        return self.sizes[head]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word; its last byte carries the end mark."""
        if not word:
            return []
        n = len(word)
        inner, final, sizes, memo, follows = self.inner, self.final, self.sizes, self.merges.memo, self.merges.follows
        path: list[int] = []
        places: list[int] = []
        closed: set[int] = set()
        at, before, limit = 0, -1, n
        while at < n:
            # the longest arc that is left to try from here
            head = word[at : at + HEAD]
            for size in sizes.get(head) or self.lengths(head):
                to = at + size
                if size > limit or to > n or to in closed:
                    continue
                t = final.get(word[at:]) if to == n else inner.get(word[at:to])
                if t is None:
                    continue
                if before < 0:
                    break
                ok = memo.get(before * IDS + t)
                if follows(before, t) if ok is None else ok:
                    break
            else:
                closed.add(at)
                limit = at - places[-1] - 1
                at = places.pop()
                path.pop()
                before = path[-1] if path else -1
                continue
            path.append(t)
            places.append(at)
            at, before, limit = to, t, n
        return path


class Remembered(dict):
    """What ``make`` gives for the words asked for since ``keep`` last found ``size / 2`` of them,
    and, while they are asked for again, for those before."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def keep(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        return got


class WordBpe:
    """Normaliser, splitter and automaton of a lower-casing BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.automaton = WordAutomaton(vocab, model["merges"], self.end)
        self.label = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        rule = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(rule["pattern"]["Regex"])
        # the same rule for ASCII alone, in half the time
        self.split_ascii = re.compile(rule["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        # the library's own tables, for characters that its version of Unicode may know otherwise
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})).normalizer
        self.library_split = pre_tokenizers.Split(Regex(rule["pattern"]["Regex"]), rule["behavior"].lower(), rule["invert"])
        self.memo = Remembered(self.word, MEMO)

    def forget(self) -> None:
        self.memo = Remembered(self.word, MEMO)
        self.automaton.merges.memo.clear()

    def words(self, text: str) -> list[str]:
        """The normalised text in pre-split words."""
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        if max(text) >= SETTLED:
            return [w for w, _ in self.library_split.pre_tokenize_str(self.library.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        return self.split.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32-bit) and arc labels of a pre-split word."""
        ids = self.automaton.encode(word.encode())
        return array("I", ids).tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The arc labels of ``ids``, special tokens included; ids that the file lacks have none."""
        label = self.label
        return " ".join([label[i] for i in ids if i in label])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        ids, labels = [], []
        for k, part in enumerate(self.cut.split(text) if any(s in text for s in self.special) else [text]):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                labels.append(part)
            elif part and (words := self.words(part)):
                self.memo.keep()
                a, b = zip(*map(self.memo.__getitem__, words), strict=True)
                ids += a
                labels += b
        return b"".join(ids), " ".join(labels)


def _mapped(docs: DataFrame, tokenizer_path: str, fn, schema: str) -> DataFrame:
    """``fn(encoder, batch)`` over all batches. What the encoder has remembered goes with the
    task, since Python workers live on and other stages need the memory."""

    def run(batches):
        enc = word_bpe(tokenizer_path)
        try:
            for b in in_parts(batches):
                yield from fn(enc, b)
        finally:
            enc.forget()
            give_back()

    return small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))).mapInArrow(run, schema)


def word_bpe(path: str) -> WordBpe:
    return kept(("bpe", path), lambda: WordBpe(path))


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, decoded string for every row of ``encoded(doc_id, ids array<int>, ...)``.

    Null or no ids decode to the empty string; null ids and ids that the tokenizer lacks are
    left out, as the library does with the latter. Repeated rows and null doc_ids each give a
    row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batch):
        enc = word_bpe(tokenizer_path)
        back = [enc.decode(ids.as_py() or []) for ids in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], names=["doc_id", "decoded"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_arrow(rows, run, "doc_id bigint, decoded string", keeps=True)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of ``docs(doc_id, text, ...)``.

    A null or empty text has no ids and decodes to the empty string. Repeated rows and null
    doc_ids each give a row; an empty table gives an empty result; other columns are ignored.
    """
    import numpy as np

    def run(enc, batch):
        # in parts: ids and labels are several times as long as the texts
        for lo in range(0, batch.num_rows, 250):
            part = batch.slice(lo, 250)
            ids, back = [], []
            for t in part.column("text"):
                a, b = enc.encode(t.as_py())
                ids.append(np.frombuffer(a, "<u4").astype(np.int32))
                back.append(b)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return _mapped(docs, tokenizer_path, run, "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As ``encode_documents``, with n_tokens and the SHA-256 of ids and decoded text instead,
    so that no task returns more than a row of fixed size per document."""

    def run(enc, batch):
        n, a, b = [], [], []
        for t in batch.column("text").to_pylist():
            ids, back = enc.encode(t)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(back.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _mapped(docs, tokenizer_path, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
