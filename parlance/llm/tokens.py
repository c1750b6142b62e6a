"""Token ids of whole texts with a public tokenizer file, piece by piece.

The tokenizer's pre-tokenizer drops white space, never joins what white space
parts, and parts runs of letters from runs of punctuation; it lower-cases. So a
text's ids are the ids of its pieces in order: runs of letters in lower case and
runs of punctuation. Each distinct piece is encoded once and remembered
(bounded), which is several times faster than encoding whole texts and gives the
same ids. Where a piece's ids could depend on its neighbours (apostrophes, other
signs, odd white space, special tokens), the pieces stay together.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from parlance.llm.support import kept

#: White space that str.split() would cut at although it is not plain ASCII space;
#: the tokenizer itself decides about these, so texts with them are cut by PLAIN.
ODD_ASCII = "\x1c\x1d\x1e\x1f"
ODD_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = re.compile("[ \t\n\r\x0b\x0c]+")
#: A run of ASCII punctuation (no apostrophe: it has rules of its own) between
#: letters, digits, white space or the text's ends.
RUN = re.compile(r"[!-&(-/:-@\[-`{-~](?<![^\w\s].)(?<!_.)[!-&(-/:-@\[-`{-~]*+(?![^\w\s])", re.DOTALL)
#: What the splitting pattern of such a tokenizer must have.
SPLIT = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters whose lower case depends on their neighbours, or is two letters.
FOLDS_BY_PLACE = "\u03a3\u0130"
#: Distinct pieces remembered by a worker, in each of two generations (about 200 bytes
#: a piece, 240 MB at most in all). A text's rare words are most of what is learned again.
REMEMBERED = 600_000
END_ID = 1


class Pieces(dict):
    """Ids by piece; remembers which pieces were asked for in vain."""

    def __init__(self):
        super().__init__()
        self.lacking: list[str] = []

    def __missing__(self, piece):
        self.lacking.append(piece)


class WordEncoder:
    """Texts to packed little-endian unsigned ids (16 bits if the vocabulary
    allows, else 32; ``dtype`` says which). A tokenizer that keeps white space
    or letter case encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = (getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
                         and "Lowercase" in str(self.tokenizer.normalizer) and SPLIT in str(self.tokenizer.pre_tokenizer))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.new, self.old = Pieces(), Pieces()
        if self.by_piece:
            # Words of letters need neither the splitting pattern nor offsets: the last
            # id of each is one that ends a word.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith("</w>")

    def _store(self, pieces: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        packed, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
        for piece, a, b in zip(pieces, cuts, cuts[1:]):
            self.new[piece] = packed[a:b]

    def _learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces, many at a time as one text."""
        plain = [p.isalpha() and p == p.lower() and unicodedata.is_normalized("NFC", p) for p in pieces]
        words = [p for p, x in zip(pieces, plain) if x]
        for lo in range(0, len(words), 4000):
            part = words[lo:lo + 4000]
            ids = np.array(self.plain.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            self._store(part, ids, np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1)))
        others = [p for p, x in zip(pieces, plain) if not x]
        for lo in range(0, len(others), 4000):
            part = others[lo:lo + 4000]
            e = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            begins = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            self._store(part, np.array(e.ids, self.dtype), np.searchsorted(begins, starts))

    def pieces(self, text: str) -> list[str]:
        if any(c in text for c in ODD_ASCII) or not text.isascii() and any(c in text for c in ODD_SPACE):
            return PLAIN.split(text)
        if "<" in text and self.special.search(text) or not text.isascii() and any(c in text for c in FOLDS_BY_PLACE):
            return text.split()
        return RUN.sub(r" \g<0> ", text.lower()).split()

    def many(self, texts: list[str], end_id: int | None = END_ID) -> list[bytes]:
        """Packed ids of each text, with ``end_id`` appended if given."""
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        if not self.by_piece:
            whole = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() + end for e in whole]
        out = []
        for lo in range(0, len(texts), 64):
            if len(self.new) > REMEMBERED:
                self.old, self.new = self.new, Pieces()
            new, old = self.new, self.old
            cut = [self.pieces(t) for t in texts[lo:lo + 64]]
            found = [list(map(new.__getitem__, pieces)) for pieces in cut]
            if new.lacking:
                lacking, new.lacking = set(new.lacking), []
                kept = [p for p in lacking if p in old]
                new.update((p, old[p]) for p in kept)
                self._learn(list(lacking.difference(kept)))
                for pieces, ids in zip(cut, found):
                    at = -1
                    for _ in range(ids.count(None)):
                        at = ids.index(None, at + 1)
                        ids[at] = new[pieces[at]]
            for ids in found:
                ids.append(end)
                out.append(b"".join(ids))
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    mine = kept("tokens")
    if path not in mine:
        mine[path] = WordEncoder(path)
    return mine[path]


def default_path() -> str:
    """The public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
