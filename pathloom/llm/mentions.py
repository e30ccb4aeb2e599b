"""Mapping free-entered values to the entries of a reference list.

A multi-pattern automaton over names and aliases finds embedded mentions; the
longest match wins and matches do not overlap.  A value that no pattern covers
goes to a token-set similarity whose token equality tolerates misspellings.

Defined results: a null or blank value has no row of its own and is dropped by
the packed-field operator before it gets here; an empty reference list maps
everything to -1; a value naming two entries maps to the longest mention, ties
to the earliest one, then to the smallest id.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import ahocorasick
import numpy as np

# Words that dress a skill up without naming another one.
DRESSING = (
    "advanced applied basic beginner certified essentials etc expert expertise experience fundamentals "
    "general good hands intermediate intro introduction introductory knowledge level of on practical "
    "proficiency proficient senior skill skills solid strong suite to working in with and the a ms pro "
    "i ii iii iv v 1 2 3 4 5"
).split()
# Signs that are typed in place of a letter.
LOOKALIKE = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i"}
WHOLE_ONLY = 6  # an alias of at most so many letters names an entry only as the whole value
MIN_TOKEN_SIMILARITY = 0.6
MIN_SET_SIMILARITY = 0.7
SAME_START = 0.01  # of two equally near words, the one with the same first letter is meant
# A word two or more edits from a word of the list is a word of its own if it makes up such a share of
# all that looks like that word, and such a share of its values would name no entry with that word in
# its place: a misspelling stands where the list's word would stand.  Shares do not grow with the input.
OWN_SHARE, OWN_UNNAMED = 0.05, 0.5


def plain(text: str) -> str:
    """Lower case without accents, ph read as f; every sign but letters and digits is a blank; blanks are single."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold().replace("ph", "f")
    return re.sub(r"[\W_]+", " ", text).strip()


def letters(token: str) -> str:
    """Digits standing among letters are read as the letters they look like."""
    if token.isdigit() or token.isalpha() or sum(c.isdigit() for c in token) * 2 > len(token):
        return token
    return "".join(LOOKALIKE.get(c, c) for c in token)


def split_humps(text: str) -> str:
    """CamelCase of two full words becomes two words."""
    return re.sub(r"(?<=[^\W\d_])(?<=[a-zà-ÿ])(?=[A-Z])", " ", text)


class Edits:
    """Edits (insert, drop, change, swap of neighbours) from one word to others, a column of the
    table of distances at a time as the bits of two integers (Hyyro's bit-parallel alignment)."""

    def __init__(self, word: str):
        self.size, self.all = len(word), (1 << len(word)) - 1
        self.at: dict[str, int] = {}
        for k, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << k

    def to(self, other: str, most: int) -> int:
        """The number of edits, or most + 1 if there are more."""
        if abs(self.size - len(other)) > most:
            return most + 1
        if not self.size:
            return len(other)
        every, last, at = self.all, 1 << (self.size - 1), self.at
        up, down, same, before, score = every, 0, 0, 0, self.size
        for c in other:
            here = at.get(c, 0)
            swapped = ((~same & here) << 1) & before
            same = ((((here & up) + up) ^ up) | here | down | swapped) & every
            grows = down | (every & ~(same | up))
            falls = same & up
            if grows & last:
                score += 1
            elif falls & last:
                score -= 1
            grows, falls = (grows << 1 | 1) & every, (falls << 1) & every
            up, down, before = falls | (every & ~(same | grows)), grows & same, here
        return min(score, most + 1)


def distance(a: str, b: str, most: int) -> int:
    """Edits from a to b, or most + 1 if there are more."""
    return Edits(a).to(b, most)


class Grams:
    """Words by their pairs of letters: those of about the length of a given one that share at least so many with it."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(words)
        at: dict[str, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            for g in self.of(w):
                at[g].append(k)
        self.at = {g: np.array(v) for g, v in at.items()}
        self.lengths = np.array([len(w) for w in self.words], np.int64)

    @staticmethod
    def of(word: str) -> set[str]:
        w = f"^{word}$"
        return {w[k : k + 2] for k in range(len(w) - 1)}

    def sharing(self, word: str, most: int) -> list[str]:
        """Words that may be within `most` edits: an edit touches three pairs at most."""
        hits = [self.at[g] for g in self.of(word) if g in self.at]
        if not hits:
            return []
        shared = np.bincount(np.concatenate(hits), minlength=len(self.words)) >= max(1, len(word) + 1 - 3 * most)
        return [self.words[k] for k in np.flatnonzero(shared & (np.abs(self.lengths - len(word)) <= most))]


def allowed_edits(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 9 else 3


def derived_aliases(name: str) -> list[str]:
    """Shortened forms that people write by rule: three letters of each word, one word cut off, the words turned round."""
    words = plain(name).split()
    out = []
    if len(words) == 1 and len(words[0]) > 5:
        out.append(words[0][:4])
    if len(words) == 2:
        a, b = words
        out.append(a[:3] + b[:3])
        out += [f"{a[:n]} {b}" for n in range(3, len(a))]
        out += [f"{a} {b[:n]}" for n in range(3, len(b))]
        out += [f"{b} {a}", f"{b} of {a}", a + b]
    return out


class Mentions:
    """Names and aliases compiled once; `find` maps one value.

    `own_words` are words known to be no misspellings although they look like ones."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], own_words: frozenset[str] = frozenset()):
        self.own_words = own_words
        self.names = sorted({(i, n) for i, n, _ in entries if i is not None and n})
        patterns: dict[str, set[int]] = defaultdict(set)
        for i, n, aliases in entries:
            if i is None or not n:
                continue
            for alias in [n, *aliases]:
                if alias and plain(alias):
                    patterns[plain(alias)].add(i)
        derived: dict[str, set[int]] = defaultdict(set)
        for i, n in self.names:
            for alias in derived_aliases(n):
                derived[alias].add(i)
        for alias, ids in derived.items():  # a listed alias is never overruled by a derived one
            if alias not in patterns and len(ids) == 1:
                patterns[alias] |= ids
        self.patterns = {p: min(ids) for p, ids in patterns.items() if len(ids) == 1 or any(plain(n) == p for i, n in self.names if i in ids)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.patterns.items():
            self.automaton.add_word(f" {p} ", (len(p), i))
        if self.patterns:
            self.automaton.make_automaton()
        self.tokens: dict[str, set[int]] = defaultdict(set)
        self.words: dict[int, list[str]] = {}
        for i, n in self.names:
            self.words[i] = plain(n).split()
            for w in self.words[i]:
                self.tokens[w].add(i)
        self.grams = Grams(self.tokens)
        self.joined = {"".join(ws): i for i, ws in self.words.items()}
        self.joined_grams = Grams(self.joined)
        self.memo: dict[str, list[tuple[str, float]]] = {}

    def look_alike(self, word: str) -> tuple[str, int] | None:
        """The word of the list that a word not in it would be taken for, and how many edits they are apart."""
        if word in self.tokens or word in DRESSING or not (near := self._near(word)):
            return None
        target = max(near, key=lambda x: (x[1], x[0]))[0]
        return target, distance(word, target, allowed_edits(len(word)))

    def find(self, value: str | None) -> tuple[int, str]:
        """(id, how); id -1 if the value names no entry. how: name, alias, mention, similar or none."""
        if value is None or not self.patterns:
            return -1, "none"
        forms = []
        for text in (value, split_humps(value)):
            p = plain(text)
            for form in (p, " ".join(letters(t) for t in p.split())):
                if form and form not in forms:
                    forms.append(form)
        for form in forms:
            if form in self.patterns:
                return self.patterns[form], "alias"
        for form in forms:
            if (i := self._mention(form)) is not None:
                return i, "mention"
        best = (0.0, -1)
        for form in forms:
            best = max(best, self._similar(form), key=lambda x: (x[0], -x[1]))
        return (best[1], "similar") if best[1] >= 0 else (-1, "none")

    def _mention(self, form: str) -> int | None:
        """Longest non-overlapping mentions; the words outside them must be dressing."""
        hits = []
        text = f" {form} "
        for end, (n, i) in self.automaton.iter(text):
            start = end - n  # of the pattern in form's own positions, less the blank in front
            if n > WHOLE_ONLY or n == len(form):
                hits.append((-n, start - 1, i, n))
        covered: list[tuple[int, int, int]] = []
        for _, start, i, n in sorted(hits):
            if all(start + n <= s or start >= e for s, e, _ in covered):
                covered.append((start, start + n, i))
        if not covered:
            return self._short(form)
        rest, at = [], 0
        for s, e, _ in sorted(covered):
            rest += form[at:s].split()
            at = e
        rest += form[at:].split()
        if all(w in DRESSING for w in rest):
            return covered[0][2]
        return None

    def _short(self, form: str) -> int | None:
        """A short alias with nothing but dressing around it."""
        core = [w for w in form.split() if w not in DRESSING]
        return self.patterns.get(" ".join(core)) if core else None

    def _near(self, word: str) -> list[tuple[str, float]]:
        """Words of the list within the allowed edits of a word, with their similarity."""
        if (got := self.memo.get(word)) is not None:
            return got
        if word in self.tokens:  # a word of the list is no misspelling of another one
            return [(word, 1.0)]
        if word in self.own_words:
            return []
        most, edits, out = allowed_edits(len(word)), Edits(word), []
        for w in self.grams.sharing(word, most):
            if (d := edits.to(w, most)) <= most:
                out.append((w, 1 - d / max(len(w), len(word)) + SAME_START * (w[0] == word[0])))
        out = [x for x in out if x[1] >= MIN_TOKEN_SIMILARITY]
        if len(self.memo) < 200_000:
            self.memo[word] = out
        return out

    def _similar(self, form: str) -> tuple[float, int]:
        """Token-set similarity: each word is paired with its most similar word of an entry, dressing is left out."""
        words = [w for w in form.split() if w not in DRESSING] or form.split()
        scores: dict[int, dict[str, float]] = defaultdict(dict)
        for w in set(words):
            for near, s in self._near(w):
                for i in self.tokens[near]:
                    if s > scores[i].get(near, 0.0):
                        scores[i][near] = s
        found = []
        for i, pairs in scores.items():
            own = set(self.words[i])
            content = [w for w in own if w not in DRESSING] or list(own)
            shared = sum(s for w, s in pairs.items() if w in content)
            if len(pairs) >= len(content) and all(w in pairs for w in content):
                size = max(len(content), len(set(w for w in words if w not in DRESSING or w in own)))
                found.append((shared / size, -i))
        # a blank lost, gained or misplaced, or one word badly misspelt: compare the letters run together
        run = "".join(words)
        if len(run) >= 6 and not all(w in self.tokens for w in words) and not any(w in self.own_words for w in words):
            most = 3 if len(run) > 11 else 2 if len(run) > 8 else 1
            edits = Edits(run)
            for j in self.joined_grams.sharing(run, most):
                if (d := edits.to(j, most)) <= most:
                    found.append((1 - d / max(len(run), len(j)), -self.joined[j]))
        found = sorted(found, reverse=True)
        if found and found[0][0] >= MIN_SET_SIMILARITY:
            return found[0][0], -found[0][1]
        return 0.0, -1
