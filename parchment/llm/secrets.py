"""Secret scans: fixed formats by pattern, others by grammar inference.

The patterns find the three base kinds. Beside them, labelled credentials (and labelled ordinary strings) are made
into prefix trees whose statistically compatible states are merged (ALERGIA), which gives two probabilistic automata.
Every run of credential characters that no base span covers is a candidate, of any length, and so is each part of it
between `/`, `=`, `.` and `:` where the whole is none. A candidate is scored by its likelihood as a credential against
that of an ordinary string; it is told, as kind `learned`, if the evidence outweighs how rare credentials are.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import at_work, prepare

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of lower-case hex of 24 and more, from where no such character stands before.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
PART = re.compile(r"[A-Za-z0-9+_-]+")
#: Nats by which a candidate must look more like a credential: the odds of one among a corpus's strings are put at one
#: in 1.2 million; nats a character, so that a long string doesn't gather them from small differences; labelled strings
#: a format; distinct strings remembered; the share of characters that follow no grammar.
EVIDENCE, MARGIN, LABELLED, REMEMBERED, CHANCE = 14.0, 0.25, 200, 100_000, 0.02

_CLASS = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")}
_WIDTH = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


def symbols(text: str) -> str:
    """The string with each letter and digit as its class; other characters stand for themselves."""
    return "".join(_CLASS.get(c, c) for c in text)


class Automaton:
    """A deterministic probabilistic automaton learnt by ALERGIA: merge states of the prefix tree that pass a
    Hoeffding test on their next symbols and ends, and so on below them."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        self.ends, self.visits = [0], [0]
        for text in strings:
            at = 0
            self.visits[0] += 1
            for s in symbols(text):
                self.seen[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                    self.ends.append(0)
                    self.visits.append(0)
                at = self.next[at][s]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], sorted(self.next[0].values())
        while blue:
            state = max(blue, key=lambda q: (self.visits[q], -q))
            blue.remove(state)
            for target in red:
                if self._alike(target, state):
                    self._redirect(state, target)
                    self._fold(target, state)
                    break
            else:
                red.append(state)
            inside = set(red)
            blue = sorted({q for r in red for q in self.next[r].values()} - inside)
        self._trim(red)

    def _trim(self, kept: list[int]) -> None:
        """Only the states that are left, from 0 on; a worker gets no prefix tree."""
        number = {q: k for k, q in enumerate(kept)}
        self.next = [{s: number[q] for s, q in self.next[p].items()} for p in kept]
        self.seen = [dict(self.seen[p]) for p in kept]
        self.ends, self.visits = [self.ends[p] for p in kept], [self.visits[p] for p in kept]
        self.states = list(range(len(kept)))

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _alike(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.visits[p], self.visits[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for s in self.seen[p].keys() | self.seen[q].keys():
                if self._differ(self.seen[p].get(s, 0), n, self.seen[q].get(s, 0), m):
                    return False
                if s in self.next[p] and s in self.next[q] and self.next[p][s] != self.next[q][s]:
                    stack.append((self.next[p][s], self.next[q][s]))
        return True

    def _redirect(self, old: int, new: int) -> None:
        for edges in self.next:
            for s, q in edges.items():
                if q == old:
                    edges[s] = new

    def _fold(self, p: int, q: int) -> None:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if p == q:
                continue
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for s, n in list(self.seen[q].items()):
                self.seen[p][s] += n
                if s in self.next[p]:
                    stack.append((self.next[p][s], self.next[q][s]))
                else:
                    self.next[p][s] = self.next[q][s]

    def step(self, at: int, c: str) -> tuple[float, int]:
        """Log likelihood of a character, by its class, in a state, and the next state: a small share of all characters
        is put down to chance, and what no labelled string has there leads back to the first state."""
        share = self.seen[at].get(c, 0) / max(1, self.visits[at]) / _WIDTH.get(c, 1)
        return math.log((1 - CHANCE) * share + CHANCE / 67), self.next[at].get(c, 0)

    def end(self, at: int) -> float:
        return math.log((1 - CHANCE) * self.ends[at] / max(1, self.visits[at]) + CHANCE / 67)


def _runs_of(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans as runs that don't overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def labelled_credentials(count: int = LABELLED, seed: int = 1) -> list[str]:
    """Credentials of published formats with random bodies: count of each format."""
    rng = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    body = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    formats = (
        lambda: "AKIA" + body(upper + "234567", 16),
        lambda: body("0123456789abcdef", rng.choice((32, 40, 64))),
        lambda: "ghp_" + body(upper + lower + digit, 36),
        lambda: "sk-" + body(upper + lower + digit, 48),
        lambda: "xoxb-" + body(digit, 12) + "-" + body(upper + lower + digit, 24),
        lambda: body(upper + lower + digit + "+/", rng.choice((32, 40, 44))) + rng.choice(("", "=", "==")),
        lambda: body(upper + lower + digit, rng.randint(12, 24)),
        lambda: body(lower + digit, rng.choice((20, 24, 32))),
        lambda: "eyJ" + body(upper + lower + digit, 30) + "." + body(upper + lower + digit + "_-", 40) + "." + body(upper + lower + digit + "_-", 43),
    )
    return [make() for make in formats for _ in range(count)]


def labelled_ordinary(count: int = LABELLED, seed: int = 2) -> list[str]:
    """Strings of credential characters that are none: words, identifiers, numbers, dates, paths, versions, UUIDs."""
    rng = random.Random(seed)
    syllables = ("an", "ber", "ci", "der", "ed", "en", "er", "ion", "ing", "la", "le", "ment", "on", "ou", "que", "re", "sch", "st", "th", "ti", "tion", "un", "ver", "wh", "zu", "k", "jo", "pra", "xi", "fy", "gno", "mb")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    number = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    some = lambda: number(rng.randint(1, 9))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    formats = (
        word,
        lambda: word() + ".",
        lambda: word().capitalize(),
        lambda: word().upper(),
        some,
        lambda: "_".join(word() for _ in range(rng.randint(2, 6))).upper(),
        lambda: word().upper() + "_" + word().upper() + some(),
        lambda: "".join(word() for _ in range(3)),
        lambda: word().capitalize() + "." + word().capitalize() + "." + word(),
        lambda: "-".join(word() for _ in range(4)),
        lambda: "_".join(word() for _ in range(rng.randint(2, 4))),
        lambda: word() + "_" + word() + "_" + number(4),
        lambda: word() + word() + "." + number(2),
        lambda: word() + some() + word() + some(),
        lambda: word() + some(),
        lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(1, 3))) + rng.choice(("", some())),
        lambda: f"{number(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{number(2)}.{number(2)}.{number(6)}",
        lambda: f"{number(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: "/" + word() + "/" + word() + "/" + word() + "/" + number(3) + ".html",
        lambda: "//" + word() + "." + word() + ".com/" + word() + "/" + word() + some(),
        lambda: ".".join(number(3) for _ in range(rng.randint(2, 5))),
        lambda: "-".join(hexed(n) for n in (8, 4, 4, 4, 12)),
        lambda: hexed(rng.choice((6, 7, 8, 10, 12))),
        lambda: number(rng.randint(10, 19)),
        lambda: "-".join(some() for _ in range(rng.randint(2, 5))),
        lambda: rng.choice("=-_.") * rng.randint(2, 40) + rng.choice(("", word())),
    )
    return [make() for make in formats for _ in range(count)]


class Scanner:
    """Finds spans (start, end, kind) in a text; offsets are code points and end is exclusive."""

    def __init__(self, credentials: list[str] | None = None, ordinary: list[str] | None = None, evidence: float = EVIDENCE, margin: float = MARGIN):
        self.credential = Automaton(credentials or labelled_credentials())
        self.ordinary = Automaton(ordinary or labelled_ordinary())
        self.evidence, self.margin = evidence, margin
        self._forget()
        #: So long may a word of such letters be before any word of its kind can gather the evidence.
        self.dull = {kind: self._bound(*of) for kind, of in (("lower", ("ag", "ag")), ("title", ("AG", "ag")), ("upper", ("AG", "AG")), ("digits", ("0", "0")))}

    def _forget(self) -> None:
        self.plain: set[str] = set()
        self.steps: dict[tuple[int, int], dict[str, tuple[float, tuple[int, int]]]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("plain", "steps")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def _bound(self, first: str, rest: str, most: int = 60) -> int:
        """The greatest length, up to `most`, at which the likeliest credential of these classes lacks the evidence."""
        best = {(0, 0): 0.0}
        for length in range(1, most + 1):
            new: dict[tuple[int, int], float] = {}
            for at, total in best.items():
                for c in first if length == 1 else rest:
                    (a, p), (b, q) = self.credential.step(at[0], c), self.ordinary.step(at[1], c)
                    new[p, q] = max(new.get((p, q), -math.inf), total + a - b)
            best = new
            if max(v + self.credential.end(p) - self.ordinary.end(q) for (p, q), v in best.items()) >= self.evidence:
                return length - 1
        return most

    def _plainly(self, word: str) -> bool:
        """Whether no word of this kind and length can be told, so that this one need not be scored."""
        if not word.isalpha():
            return word.isdigit() and len(word) <= self.dull["digits"]
        kind = "lower" if word.islower() else "upper" if word.isupper() else "title" if word[1:].islower() else None
        return kind is not None and len(word) <= self.dull[kind]

    def likelihood(self, text: str) -> float:
        """Nats in favour of a credential. Both automata step at once; what a step weighs is remembered by states and class."""
        at, total = (0, 0), 0.0
        for c in symbols(text):
            row = self.steps.get(at)
            if row is None:
                row = self.steps[at] = {}
            step = row.get(c)
            if step is None:
                (a, p), (b, q) = self.credential.step(at[0], c), self.ordinary.step(at[1], c)
                step = row[c] = (a - b, (p, q))
            total += step[0]
            at = step[1]
        return total + self.credential.end(at[0]) - self.ordinary.end(at[1])

    def told(self, text: str) -> bool:
        found = self.likelihood(text)
        return found >= self.evidence and found >= self.margin * len(text)

    def _secret(self, run: str) -> list[tuple[int, int]]:
        """The spans in a run: the whole, less the dots and dashes at its ends, or else those of its parts that are told."""
        bare = run.strip(".-_/")
        if not bare or self._plainly(bare):
            return []
        start = run.index(bare)
        if self.told(bare):
            return [(start, start + len(bare))]
        return [(m.start(), m.end()) for m in PART.finditer(run) if len(m[0]) < len(bare) and self.told(m[0])]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        found = []
        if "passw" in low or "secret" in low or "token" in low or "api" in low:
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        return found

    def scan(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        found, runs = self.base(text), set(CANDIDATE.findall(text))
        if any(len(run) >= 24 and LONG_HEX.search(run) for run in runs):
            found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
        # runs known to hold nothing are passed over as a set; the rest are few
        runs -= self.plain
        odd = {}
        for run in runs:
            if spans := self._secret(run):
                odd[run] = spans
        if len(self.plain) > REMEMBERED:
            self.plain = set()
        self.plain |= runs - odd.keys()
        taken = _runs_of(found)
        if odd or taken:
            for m in CANDIDATE.finditer(text):
                cuts = [(a, b) for a, b in taken if a < m.end() and m.start() < b] if taken else []
                if cuts:  # what base spans leave of the run
                    at = m.start()
                    for a, b in [*cuts, (m.end(), m.end())]:
                        if at < a:
                            found += [(at + x, at + y, "learned") for x, y in self._secret(text[at:a])]
                        at = max(at, b)
                elif m[0] in odd:
                    found += [(m.start() + x, m.start() + y, "learned") for x, y in odd[m[0]]]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))

    def redact(self, text: str | None) -> str | None:
        """The text with each span, overlapping ones as one, replaced by [SECRET]."""
        spans = self.scan(text)
        if not spans:
            return text
        out, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join(out) + text[at:]


def spans_of(text: Column, scanner: Scanner | None = None) -> Column:
    """An array of (kind, start, end) by start, then kind; empty for null and empty texts."""
    held = scanner or Scanner()

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: pd.Series) -> pd.Series:
        at_work()
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in held.scan(t)] for t in texts])

    return spans(text)


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id and its `secrets`, an array of (kind, start, end), for every row of docs (doc_id, text).

    Null and empty texts have no spans; null and repeated doc_ids are kept as rows; other columns are ignored. Each
    text is scanned whole and alone, so no group of rows can be hot. Matches of the base patterns stay whatever the
    automata say; learned spans never overlap them.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", spans_of(F.col("text").cast("string"), scanner).alias("secrets"))


def redact_secrets(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs with every secret in text replaced by [SECRET]; n_chars follows where there is one. No row goes."""
    prepare(docs.sparkSession)
    held = scanner or Scanner()

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        at_work()
        return pd.Series([held.redact(t) for t in texts], dtype=object)

    out = docs.withColumn("text", redacted(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
