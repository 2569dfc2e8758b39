"""Exact and fast token ids and counts: pre-tokens are encoded once per worker, not once per occurrence.

Byte-level BPE never merges across a pre-token, and the pre-token pattern always
starts a new pre-token at a single space or newline between two words. So a text
is cut there, each different piece is encoded once with the tokenizers library,
and the ids are put together. Marks at the end of a word are pre-tokens of their own
where a letter or digit is before them, so a word that isn't known with them is
looked up without them. Texts with any other white space are cut only at
spaces that a word follows, which is always a boundary. Tokenizers whose
pre-tokenizer is of another kind encode whole texts.
"""

from __future__ import annotations

import re

#: Entries kept in a worker's cache before it is emptied; about 100 bytes each.
CACHE_ENTRIES = 900_000
#: Longer pieces are encoded but not kept.
CACHE_CHARS = 48

#: Marks that no pre-token has after a letter or digit. An apostrophe is none: it begins contractions.
_MARKS = ".,;:!?\"&$%#*)]}"
_SPACE = re.compile(" (?=[^\\s᠎​])")
_WORKER: dict = {}


def tokenizer_path(name: str) -> str:
    """A file's path: an existing path as it is, else that of the public file of this name."""
    import os

    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


def plain_chunks(text: str) -> list[str] | None:
    """The text cut at its single spaces and newlines; a chunk keeps its newline. None if it has other white space."""
    if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return None
    if text[0] in " \n" or text[-1] in " \n" or "᠎" in text or "​" in text:
        return None
    chunks = text.replace("\n", " \n").split(" ")
    return chunks if len(text.split()) == len(chunks) else None


class IdEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to those of `Tokenizer.encode`."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import json
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.splits = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not spec.get("normalizer")
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and not any(re.search(r"\s", x) for x in added)
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", []))
        )
        self.cuts_marks = not any(m in x for x in added for m in _MARKS)
        # Bytes of text that an id stands for: a byte-level token has one character for each.
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {x["id"]: len(x["content"].encode()) for x in spec.get("added_tokens", [])}
        self.id_bytes = np.zeros(max(sizes, default=0) + 1, np.int64)
        self.id_bytes[list(sizes)] = list(sizes.values())
        self.cache: dict[str, bytes] = {}  # of a chunk that a space precedes, or that starts with a newline
        self.marks: dict[str, bytes] = {}  # of marks at the end of a chunk
        self.cache_entries = cache_entries

    def _stem(self, chunk: str) -> str:
        """A chunk without the marks at its end; whole where they may belong to what is before them."""
        stem = chunk.rstrip(_MARKS)
        return stem if stem and len(stem) < len(chunk) and stem[-1].isascii() and stem[-1].isalnum() and self.cuts_marks else chunk

    def _encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that hold no white space but a leading newline: encoded as one text, cut again by the bytes that ids stand for."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(chunks), 4000):
            units = [c if c[0] == "\n" else " " + c for c in chunks[at : at + 4000]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
            reached = np.cumsum(self.id_bytes[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if cuts[-1] == len(ids) and np.array_equal(reached[cuts - 1], ends):
                raw, stops = ids.tobytes(), (cuts * 4).tolist()
                out += [raw[i:j] for i, j in zip([0, *stops[:-1]], stops)]
            else:
                out += self._encode(units)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.splits:
            return self._encode([t or "" for t in texts])
        cut, plain, other, tails, get, stem_of = [], {}, {}, {}, self.cache.get, self._stem
        for text in texts:
            text = text or ""
            chunks = plain_chunks(text)
            new = plain
            if chunks is None:
                chunks, new = _SPACE.split(text), other
            first = chunks.pop(0)
            ids = list(map(get, chunks))
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else ()
            left = []
            for i in gaps:
                c = chunks[i]
                stem = stem_of(c)
                tail = c[len(stem) :]
                known = get(stem) if tail else None
                if tail and tail not in self.marks:
                    tails[tail] = None
                if known is None:
                    new[stem] = None
                left.append((i, c, stem, tail, known))
            cut.append((first, ids, left))
        need, rest = list(plain), [c for c in other if c not in plain]
        found = dict(zip(need, self._encode_chunks(need))) | dict(zip(rest, self._encode([" " + c for c in rest])))
        if tails:
            if len(self.marks) > 10_000:
                self.marks.clear()
                tails |= dict.fromkeys(x[3] for _, _, left in cut for x in left if x[3])
            self.marks.update(zip(tails, self._encode(list(tails))))
        out, again = [], {}
        for start, (_, ids, left) in zip(self._encode([first for first, _, _ in cut]), cut):
            for i, c, stem, tail, known in left:
                if not tail:
                    ids[i] = found[c]
                elif known is None:
                    ids[i] = found[stem] + self.marks[tail]
                else:  # a word seen before is kept with its marks, too
                    ids[i] = again[c] = known + self.marks[tail]
            out.append(start + b"".join(ids))
        self.cache.update((c, x) for c, x in again.items() if len(c) <= CACHE_CHARS)
        self.cache.update((c, x) for c, x in found.items() if len(c) <= CACHE_CHARS)
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        return out


class PieceCounter:
    """Token counts of whole texts, equal to the length of `SentencePieceProcessor.encode`.

    With identity normalization no piece reaches from a word into the next one's
    leading space mark, so a text's count is the sum over its words. Two tiers
    hold word counts: `frequent`, the table given, and a worker's own cache.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_entries: int = CACHE_ENTRIES):
        import numpy as np
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent = frequent or {}
        self.cache = dict(self.frequent)
        self.cache_entries = cache_entries + len(self.frequent)
        self.splits = self._splits()
        self.starts = np.array([self.model.id_to_piece(i)[:1] == "▁" for i in range(self.model.get_piece_size())])

    def _splits(self) -> bool:
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or any("\n" in p or " " in p for p in pieces):
            return False
        # Identity normalization with a space put before the text, nothing removed.
        probe = "a ﬁＡ\n½"
        return (
            "".join(x for x in m.encode(probe, out_type=str)).startswith("▁a▁ﬁ")
            and m.decode(m.encode(probe)) == probe
            and m.encode("a a", out_type=str) == ["▁a", "▁a"]
            and len(m.encode("a ")) == 2
            and len(m.encode("\n")) == 2
        )

    def _count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def _count_words(self, words: list[str]) -> list[int]:
        """Tokens of each word with its space mark; of a word after a newline without it. Words are encoded together and cut at the marks."""
        import numpy as np

        out: list[int] = []
        for at in range(0, len(words), 2000):
            group = words[at : at + 2000]
            ids = np.array(self.model.encode(" ".join(group), num_threads=1), np.int64)
            begin = np.flatnonzero(self.starts[ids])
            n = np.diff(begin, append=len(ids)).tolist() if len(begin) == len(group) else self._count(group)
            out += [k - (w[0] == "\n") for k, w in zip(n, group)]
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return self._count([t or "" for t in texts])
        cut: list[tuple[int, list] | None] = []
        need: dict[str, int] = {}
        get = self.cache.get
        for text in texts:
            text = text or ""
            # Words after a newline have no space mark: they are looked up with the newline, less the mark before it.
            if not text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or "▁" in text:
                cut.append(None)
                continue
            chunks = text.replace("\n", " \n").split(" ")
            known = list(map(get, chunks))
            if None in known:
                gaps = [c for c, n in zip(chunks, known) if n is None]
                need.update(dict.fromkeys(gaps))
                cut.append((sum(filter(None, known)), gaps))
            else:
                cut.append((sum(known), []))
        words = list(need)
        need = dict(zip(words, self._count_words(words)))
        whole = iter(self._count([t or "" for t, c in zip(texts, cut) if c is None]))
        out = [next(whole) if c is None else c[0] + sum(need[w] for w in c[1]) for c in cut]
        self.cache.update((w, n) for w, n in need.items() if len(w) <= CACHE_CHARS)
        if len(self.cache) > self.cache_entries:
            self.cache = dict(self.frequent)
        return out


def worker_encoder(name: str) -> IdEncoder:
    """This Python worker's encoder for a tokenizer file; kept between tasks."""
    key = ("ids", name)
    if key not in _WORKER:
        _WORKER[key] = IdEncoder(tokenizer_path(name))
    return _WORKER[key]


def forget() -> None:
    """Drop this Python worker's encoders: a task of another kind begins."""
    _WORKER.clear()
