"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Candidates are the matches of strict base patterns and of looser forms.
2. Regex, gazetteer and context labelers vote for or against each candidate, or
   abstain.
3. Votes are counted by pattern over the whole table; expectation-maximisation
   on the counts estimates each labeler's reliability for both classes and, from
   that, how likely each pattern's candidates are personal.
4. A logistic classifier over the candidates' own features (kind, form,
   length, neighbours) is trained on these probabilities and decides on the
   looser candidates. Base matches that pass their checks always stay.

Counts are gathered by Spark; the driver gets one row per realised combination
of votes and features, whose domains are fixed.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import small_batches, stored

#: Kinds in the order in which spans that start together are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
N_BASE = 4

#: Gazetteers and context words of the labelers.
TLDS = frozenset("com org net edu gov mil int info biz io de fr es it uk us ca eu ch at nl be pl pt se no dk fi ru cn jp in br mx au".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "420", "421", "971", "972")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
GIVEN_NAMES = "Alice Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emily Emma Francisco Georg Hans James Javier Jean Jennifer John Jose Juan Julia Karl Laura Linda Lucia Manuel Maria Marie Mark Martin Mary Michael Nicolas Olivia Patricia Paul Peter Pierre Robert Sarah Sofia Sophie Susan Thomas William Wolfgang".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Sr Sra Señor Señora".split()
CUES = {
    "email": "email e-mail mail mailto contact correo courriel write reach",
    "ip": "ip address host client login logged server from",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax telefon teléfono téléphone whatsapp",
    "ssn": "ssn social security insurance",
    "iban": "iban account bank konto compte cuenta",
    "name": "name contact dear regards signed author patient client",
}
AGAINST = frozenset("version v release chapter section isbn order invoice page figure table article serial part build".split())

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    ("email", "at ", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}")),
    ("ip", ":", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", ".", re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])")),
    ("phone", "", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z])")),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
_NAME = re.compile(r"\b(?:(?:" + "|".join(TITLES) + r")\.?\x20(?:[A-Z]\w+\x20)?|(?:" + "|".join(GIVEN_NAMES) + r")\x20)[A-Z]\w+\b")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at signs, so that long words cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns' matches that pass their checks."""
    out = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and m.end() - m.start() <= 37:
                digits = _NO_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of looser forms that overlap no base match and, of each kind, no other."""
    found = []
    if _DIGIT.search(text):
        found += [(*m.span(), KINDS.index(kind)) for kind, needs, pattern in _LOOSE[1:] if needs in text for m in pattern.finditer(text)]
    if "at " in text or "at)" in text or "at]" in text:
        found += [(*m.span(), 0) for m in _around(text)]
    found += [(*m.span(), 6) for m in _NAME.finditer(text)]
    out, taken, k = [], base, 0
    for span in sorted(found, key=lambda s: (s[0], s[2])):
        while k < len(taken) and taken[k][1] <= span[0]:
            k += 1
        if (k == len(taken) or taken[k][0] >= span[1]) and (not out or out[-1][1] <= span[0]):
            out.append(span)
    return out


def _around(text: str) -> Iterator[re.Match]:
    """Written-out addresses, looked for only about their bracketed at."""
    done = 0
    for m in re.finditer(r"[\[(]\x20?at\x20?[\])]", text):
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while start > max(done, m.start() - 65) and text[start - 1] in _LOCAL:
            start -= 1
        if whole := _LOOSE[0][2].match(text, start):
            done = whole.end()
            yield whole


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: int
    strict: bool
    before: str
    after: str
    text: str


def regex_vote(c: Candidate) -> int:
    """For: the strict form. Against: the form is there, its check fails."""
    if c.strict:
        return 1
    digits = _NO_DIGIT.sub("", c.text)
    if c.kind == 2:
        return 1 if luhn(digits) else -1
    if c.kind == 4:
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if c.kind == 5:
        plain = c.text.replace(" ", "")
        return 1 if int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1 else -1
    return 0


def gazetteer_vote(c: Candidate) -> int:
    digits = _NO_DIGIT.sub("", c.text)
    if c.kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]+", c.text.rstrip("])"))[-1].lower() in TLDS else -1
    if c.kind == 1:
        return -1 if c.text.startswith(("0.", "127.", "255.")) else 1 if not c.text.startswith(("10.", "192.168.")) else 0
    if c.kind == 2:
        return 1 if digits[0] in "3456" else -1
    if c.kind == 3:
        return (1 if digits.startswith(CALLING_CODES) else -1) if c.text[0] == "+" else 0
    if c.kind == 5:
        return 1 if IBAN_LENGTHS.get(c.text[:2]) == len(c.text.replace(" ", "")) else -1
    if c.kind == 6:
        return 1 if c.text.split()[0].rstrip(".") in GIVEN_NAMES or any(w in GIVEN_NAMES for w in c.text.split()) else 0
    return 0


_CUE_SETS = tuple(frozenset(CUES[k].split()) for k in KINDS)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def context_vote(c: Candidate) -> int:
    return int(any(w in _CUE_SETS[c.kind] for w in _WORD.findall(c.before.lower())[-6:]))


def counter_vote(c: Candidate) -> int:
    """Against: numbering words before. For: none, with a number or address of a usual length."""
    return -1 if any(w in AGAINST for w in _WORD.findall(c.before.lower())[-3:]) else 0


def border_vote(c: Candidate) -> int:
    """For: free on both sides. Against: part of a longer word or number."""
    left, right = c.before[-1:], c.after[:1]
    if left.isalnum() or right.isalnum() or left in "/=_#" and left or right in "/=_#" and right:
        return -1
    return int((not left or left in " \n\t(<[\"':,;|") and (not right or right in " \n\t)>]\"'.,;:|!?"))


LABELERS = (regex_vote, gazetteer_vote, context_vote, counter_vote, border_vote)
#: Sizes of the feature domains: length, digits, left and right neighbour, capitals.
FEATURES = (4, 4, 3, 3, 2)


def feature_values(c: Candidate) -> tuple[int, ...]:
    n, digits = c.end - c.start, len(_NO_DIGIT.sub("", c.text))
    side = lambda x: 0 if not x or x.isspace() else 2 if x.isalnum() else 1
    return (n > 9) + (n > 14) + (n > 20), (digits > 0) + (digits > 8) + (digits > 12), side(c.before[-1:]), side(c.after[:1]), int(c.text[:1].isupper())


def candidates_of(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, end, kind, strict, votes, features) of a text, the last two as numbers in mixed radix."""
    base = base_spans(text)
    out = []
    for strict, spans in ((True, base), (False, loose_spans(text, _union(base)))):
        for a, b, kind in spans:
            c = Candidate(a, b, kind, strict, text[max(0, a - 64) : a], text[b : b + 1], text[a:b])
            votes = sum((labeler(c) + 1) * 3**k for k, labeler in enumerate(LABELERS))
            code = 0
            for value, size in zip(feature_values(c), FEATURES, strict=True):
                code = code * size + value
            out.append((a, b, kind, strict, votes, code))
    return sorted(out)


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans joined where they overlap, in order."""
    out: list[tuple[int, int, int]] = []
    for a, b, kind in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), kind)
        else:
            out.append((a, b, kind))
    return out


CANDIDATES = "array<struct<start:bigint,end:bigint,kind:int,strict:boolean,votes:int,features:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with their candidates, one row per row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "end", "kind", "strict", "votes", "features"), c, strict=True)) for c in candidates_of(t)] if isinstance(t, str) else [] for t in texts], dtype=object)

    find = F.pandas_udf(run, CANDIDATES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text").cast("string")).alias("candidates"))


@dataclass
class Reliability:
    """``given[l, y, v]``: how likely labeler l votes v - 1 where the class is y; ``prior[k]``: the share of kind k that is personal."""

    given: np.ndarray
    prior: np.ndarray

    def posterior(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.stack([1 - self.prior[kind], self.prior[kind]]))
        for k in range(len(LABELERS)):
            v = votes // 3**k % 3
            log += np.where(v == 1, 0.0, np.log(self.given[k][:, v]))  # who abstains says nothing
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def estimate(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> Reliability:
    """Dawid and Skene's expectation-maximisation over vote patterns with ``n`` candidates each, from the majority's votes on."""
    v = np.stack([votes // 3**k % 3 for k in range(len(LABELERS))])
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=0)))
    for _ in range(rounds):
        # weights of a few candidates in which each labeler is right three times of four
        given = np.array([[[6.0, 1.0, 2.0], [2.0, 1.0, 6.0]]] * len(LABELERS))
        prior = np.array([[2.0, 2.0]] * len(KINDS))
        np.add.at(prior, kind, np.stack([n * (1 - p), n * p], axis=1))
        for k in range(len(LABELERS)):
            np.add.at(given[k, 0], v[k], n * (1 - p))
            np.add.at(given[k, 1], v[k], n * p)
        now = Reliability(given / given.sum(axis=2, keepdims=True), prior[:, 1] / prior.sum(axis=1))
        before, p = p, now.posterior(kind, votes)
        if np.abs(p - before).max(initial=0) < 1e-9:
            break
    return now


def design(kind: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """For each feature (kind first), the place of its value."""
    places, left = [], code
    for size in reversed(FEATURES):
        places.append(left % size)
        left = left // size
    return [kind, *reversed(places)]


def train(kind: np.ndarray, code: np.ndarray, p: np.ndarray, n: np.ndarray, *, rounds: int = 400, decay: float = 1e-3) -> list[np.ndarray]:
    """Weights of a logistic classifier for each feature value, fitted to probabilities ``p`` of ``n`` candidates each."""
    sizes = (len(KINDS), *FEATURES)
    columns = design(kind, code)
    x = np.concatenate([np.eye(s)[c] for s, c in zip(sizes, columns, strict=True)], axis=1)
    w, total = np.zeros(x.shape[1]), max(1, n.sum())
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (n * (q - p)) / total + decay * w
        curve = (x.T * (n * np.maximum(q * (1 - q), 1e-6) / total)) @ x + (decay + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return np.split(w, np.cumsum(sizes)[:-1])


def _score(found: Column, weights: list[np.ndarray]) -> Column:
    """The classifier's score of a candidate, in the JVM."""
    pick = lambda w, at: F.element_at(F.array(*(F.lit(float(x)) for x in w)), (at + 1).cast("int"))
    score, left = pick(weights[0], found["kind"]), found["features"]
    for w, size in zip(reversed(weights[1:]), reversed(FEATURES), strict=True):
        score = score + pick(w, left % size)
        left = F.floor(left / size).cast("int")
    return score


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id and the spans (start, rank, kind, end) of personal data, in code points.

    ``rank`` is the kind's place in ``KINDS``; spans are ordered by start, then
    rank. A null or empty text has none. Repeated rows have their spans each.
    An empty table gives no rows; columns other than doc_id and text are not
    read.
    """
    found = stored(candidates(docs), "candidates")
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).orderBy("kind", "votes", "features").toPandas()
    kind, votes, code, n = (counted[c].to_numpy(np.int64) for c in ("kind", "votes", "features", "n"))
    weights = train(kind, code, estimate(kind, votes, n).posterior(kind, votes), n)
    good = F.filter("candidates", lambda c: c["strict"] | (_score(c, weights) > 0))
    names = F.array(*map(F.lit, KINDS))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("rank"), F.element_at(names, c["kind"] + 1).alias("kind"), c["end"].alias("end"), c["strict"].alias("strict"))
    return found.select("doc_id", F.sort_array(F.transform(good, span)).alias("spans"))
