"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select; all in DataFrame functions.

The base rules find e-mail addresses, IPv4 addresses, card numbers (13 to 19 digits, Luhn) and phone numbers with a plus
sign; what they find always stays. Wider generators add obfuscated e-mail addresses, IPv6 addresses, card numbers with
other separators, phone numbers without a plus sign, secrets (long tokens with a digit, private keys), bank account
numbers (IBAN) and social security numbers. Their candidates overlap: one for each place where a match can start, inside
others too, and for each number of groups or labels it can have (beyond three labels of a domain, the longest). Each
gets features of its format and its context, gradient-boosted trees give its log-odds, a threshold for each kind, set
for a precision of 0.99 on examples that the trees were not fitted to, accepts it, and of those of a kind that overlap
the one with the largest log-odds stays, then the longer, then the earlier. No labels of personal data exist here, so
the trees are trained on generated examples of personal data and of look-alikes (versions, order numbers, dates, prices,
checksums, file names), half of them after words of at most ``CONTEXTS`` documents of the corpus, chosen by a hash of
the id, and on others where numbers or labels stand next to the right span. They run as CASE expressions.

The patterns are written so that Java's engine takes linear time on any text: a match starts where a run starts, and
repetitions are possessive. Matches are folded in chunks (``fold``), so that a text with a million of them takes no
time in the square of that. Nothing is shuffled; a document is one row, whatever its length.

Defined results: null counts as empty; spans are code points, end exclusive; kinds may overlap each other, but an added
span never overlaps a base one nor another of its kind; among overlapping spans of a kind equal log-odds go to the
longer, then the earlier; repeated rows get equal results; very long texts are whole; an empty table gives no rows. Only
doc_id and text are used; other columns may have any name.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import needs, text_of

#: In the order in which results list them.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")
#: Documents whose words stand before generated examples.
CONTEXTS = 400

_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def _address(labels: str) -> str:
    """An obfuscated address whose domain has so many labels before the last."""
    return rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?: ?(?:\(at\)|\[at\]|\{{at\}}|<at>) ?| at | AT | @ )(?:[A-Za-z0-9-]{{1,63}}+(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}) ?| dot | DOT | \. |\.)){labels}[a-z]{{2,63}}+(?![A-Za-z0-9])"


def _number(groups: str) -> str:
    """A phone number with so many groups after the first."""
    return rf"(?<![0-9A-Za-z+.-])\(?[0-9]{{2,4}}\)?(?:[ .-][0-9]{{2,5}}){groups}(?![0-9A-Za-z-])"


_HEX = "[0-9A-Fa-f]{1,4}"


def _account(groups: str, tail: str) -> str:
    """A bank account number with so many groups of four after the check digits."""
    return rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){groups}{tail}(?![A-Za-z0-9])"


#: One pattern for each number of groups or labels, so that a start has a candidate for each.
EACH = {
    "email": [_address(n) for n in ("{1}", "{2}", "{3}", "{4,126}")],
    "ip": [
        rf"(?<![0-9A-Fa-f:])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Fa-f:])",
        rf"(?<![0-9A-Za-z:])(?=[A-Fa-f:]*+[0-9])(?:{_HEX}(?::{_HEX}){{0,6}})?+::(?:{_HEX}(?::{_HEX}){{0,6}})?+(?![0-9A-Za-z:])",
    ],
    "card": [r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_ -]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])"],
    "phone": [_number(n) for n in ("{2}", "{3}", "{4}")],
    "secret": [
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    ],
    "iban": [_account("{2,7}", tail) for tail in ("", " ?[A-Z0-9]{1,3}+")],
    "ssn": [r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"],
}
#: A cheap test that a text must pass to hold a match at all; every match of the pattern must pass it.
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_WIDE_HINT = {
    "email": r"[(\[{<]at[)\]}>]| (?:at|AT|@) [A-Za-z0-9-]{1,63}+(?: dot | DOT | ?[(\[{]dot| ?\.)", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|::", "card": r"[0-9]{4}[./_ -]", "phone": r"[0-9][ .)-]",
    "secret": r"[A-Za-z0-9+/_-]{16}|-----BEGIN ", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CUE = r"(?i)(?:tel|phone|call|fax|mobile|cell|mail|contact|write|reach|card|visa|credit|ip|addr|host|server)[^0-9]{0,12}$"
_NAMED = r"(?i)(?:token|secret|key|passw|pwd|auth|bearer|credential)[a-z_]{0,8}[\"']?[ ]?[:=]{0,2}[ ]?[\"']?$"
_HASHED = r"(?i)(?:commit|sha-?[0-9]{0,3}|md5|checksum|digest|uuid|etag|hash|build|file|https?://[^ ]{0,16})[^A-Za-z0-9]{0,4}$"
_ACCOUNT = r"[A-Z]{2}[0-9]{2} ?(?:[A-Z0-9]{4} ?){0,4}$"
_AGAINST = r"(?i)(?:order|invoice|version|isbn|id|no|nr|ref|code|serial|part|date|page|total|price|[#$])[^0-9]{0,6}$"
#: What may follow a candidate that is part of a longer one.
_MORE = r"^(?: ?[(\[]dot[)\]]| dot |[.-][A-Za-z0-9]|[ .-][0-9]{2})"


_SPANS = "array<struct<start:bigint,end:bigint,said:string>>"
#: Elements that one inner fold takes.
FOLD = 512


def fold(items: Column, start: Column, step, kind: str, out) -> Column:
    """Flattened lists of a fold over an array, in chunks.

    start: a struct with an empty array ``out`` of the type ``kind`` and whatever else ``step(acc, x)`` carries on; ``out(acc)``
    gives the last chunk's list. An inner fold begins each chunk with an empty list, so no list that grows with the
    array is built anew for each element.
    """
    emptied = lambda acc: acc.withField("out", F.array().cast(kind))
    chunks = lambda it: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(it) - 1) / F.lit(FOLD)).cast("int"))), lambda i: F.slice(it, i * FOLD + 1, F.lit(FOLD)))
    begin = F.struct(start.alias("last"), F.array().cast(f"array<{kind}>").alias("done"))
    further = lambda acc, chunk: F.struct(F.aggregate(chunk, emptied(acc["last"]), step).alias("last"), F.concat(acc["done"], F.array(acc["last"]["out"])).cast(f"array<{kind}>").alias("done"))
    ended = lambda acc: F.flatten(F.concat(acc["done"], F.array(out(acc["last"]))))
    # the array is bound once, so that what makes it is not worked out for every chunk
    return F.element_at(F.transform(F.array(items), lambda it: F.aggregate(chunks(it), begin, further, ended)), 1)


def _placed(pieces: Column, found: Column, over: bool, at: int = 0) -> Column:
    """Spans of matches from the pieces of text before each; ``over``: the pieces leave the matches out."""
    both = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).cast("bigint").alias("skip"), m.alias("said")))
    start = F.struct(F.lit(at).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, size = acc["at"] + x["skip"], F.length(x["said"])
        one = F.struct(begin.alias("start"), (begin + size).alias("end"), x["said"].alias("said"))
        return F.struct((begin + size if over else begin).alias("at"), F.concat(acc["out"], F.array(one)).cast(_SPANS).alias("out"))

    return fold(both, start, step, _SPANS, lambda acc: acc["out"])


def spans_of(text: Column, pattern: str, hint: str) -> Column:
    """Matches, leftmost and non-overlapping, as an array of (start, end, said). The pieces between give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.when(text.rlike(hint), _placed(pieces, found, True)).otherwise(F.array().cast(_SPANS))


def candidates(text: Column, kind: str) -> Column:
    """Every start of a match of each of the patterns ``EACH[kind]``, as an array of (start, end, said); they overlap."""
    # a line end before the text is part of no match, so splitting always gives the piece before the first match
    ahead, out = F.concat(F.lit("\n"), text), F.array().cast(_SPANS)
    for pattern in EACH[kind]:
        found = F.regexp_extract_all(ahead, F.lit(f"(?=({pattern}))"), F.lit(1))
        pieces = F.slice(F.split(ahead, f"(?={pattern})", -1), F.lit(1), F.size(found))
        out = F.concat(out, _placed(pieces, found, False, -1))
    return F.when(text.rlike(_WIDE_HINT[kind]), out).otherwise(F.array().cast(_SPANS))


_RANKED = "array<struct<less:double,shorter:bigint,start:bigint,end:bigint,said:string>>"


#: Undecided spans of a group that are looked through at once.
OPEN = 32


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))


def _decided(group: Column, upto: Column) -> Column:
    """Overlapping spans by rank, as (taken, open): a span is taken if it overlaps none before it, and open, with all
    that it overlaps after it, if it ends after ``upto``, where spans that are not here yet may begin."""

    def take(acc: Column, x: Column) -> Column:
        more = lambda a, b: F.struct(F.concat(acc["taken"], a).cast(_RANKED).alias("taken"), F.concat(acc["open"], b).cast(_RANKED).alias("open"))
        one, none = F.array(x).cast(_RANKED), F.array().cast(_RANKED)
        stays = (x["end"] > upto) | _overlaps(acc["open"], x)
        return F.when(_overlaps(acc["taken"], x), acc).when(stays, more(none, one)).otherwise(more(one, none))

    return F.aggregate(F.array_sort(group), F.struct(F.array().cast(_RANKED).alias("taken"), F.array().cast(_RANKED).alias("open")), take)


def _best(group: Column) -> Column:
    """Of overlapping spans, by rank, those that overlap none before them."""
    return F.when(F.size(group) < 2, group).otherwise(_decided(group, F.lit((1 << 63) - 1).cast("bigint"))["taken"])


def select(scored: Column) -> Column:
    """Non-overlapping spans of an array of (s, margin), the largest margin first.

    Spans in order of their starts fall into groups that nothing links, and each group is decided by itself. Of a long
    group those are decided on the way that no later span can reach, so that what is carried on is not the group but
    the spans that still hang on what follows: those around the place, and runs of them that get better and better.
    """
    ordered = F.array_sort(F.transform(scored, lambda v: F.struct(v["s"]["start"].alias("start"), v["s"]["end"].alias("end"), v["s"]["said"].alias("said"), v["margin"].alias("margin"))))
    start = F.struct(F.array().cast(_RANKED).alias("out"), F.array().cast(_RANKED).alias("group"), F.lit(0).cast("bigint").alias("end"), F.lit(OPEN).alias("most"))

    def step(acc: Column, v: Column) -> Column:
        one = F.array(F.struct((-v["margin"]).alias("less"), (v["start"] - v["end"]).alias("shorter"), v["start"].alias("start"), v["end"].alias("end"), v["said"].alias("said"))).cast(_RANKED)
        state = lambda out, group, end, most: F.struct(out.alias("out"), group.alias("group"), end.alias("end"), most.alias("most"))
        end = F.greatest(acc["end"], v["end"])
        apart = state(F.concat(acc["out"], _best(acc["group"])).cast(_RANKED), one, v["end"], F.lit(OPEN))
        longer = state(acc["out"], F.concat(acc["group"], one).cast(_RANKED), end, acc["most"])
        # decided once and looked at three times; after that the group may grow to twice what is left of it
        settled = F.element_at(F.transform(F.array(_decided(acc["group"], v["start"])), lambda d: state(F.concat(acc["out"], d["taken"]).cast(_RANKED), F.concat(d["open"], one).cast(_RANKED), end, F.greatest(F.lit(OPEN), F.size(d["open"]) * 2))), 1)
        return F.when(v["start"] >= acc["end"], apart).when(F.size(acc["group"]) < acc["most"], longer).otherwise(settled)

    spans = fold(ordered, start, step, _RANKED, lambda acc: F.concat(acc["out"], _best(acc["group"])))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["said"].alias("said")))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).try_cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0)))
    return (total % 10 == 0) & (F.length(digits) > 0)


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _holds(kind: str, s: Column) -> Column:
    """What a base match must fulfil; failing ones are dropped, not tried again."""
    if kind == "ip":
        return s["said"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(s["said"])).between(13, 19) & luhn(_digits(s["said"]))
    if kind == "phone":
        return F.length(_digits(s["said"])).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans_of(text, BASE[kind], _HINT[kind]), lambda s: _holds(kind, s))


#: Numbers that describe a candidate's format and context.
FEATURES = ("kind", "digits", "marks", "length", "luhn", "groups", "paren", "before", "after", "cue", "against", "date", "sign", "more", "led", "upper", "lower", "distinct", "mod97", "named", "hashed", "account", "mixed")


def mod97(said: Column) -> Column:
    """Whether a bank account number passes its check: its digits, letters as 10 to 35 and the first four last, leave 1 modulo 97."""
    plain = F.regexp_replace(said, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, acc * 100 + v - 55).otherwise(acc * 10 + v - 48) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _edge(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def wide(text: Column) -> Column:
    """The candidates of all kinds as one array of (kind, start, end, said); a kind is its number in ``KINDS``."""
    named = lambda k: F.transform(candidates(text, KINDS[k]), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["said"].alias("said")))
    return F.concat(*[named(k) for k in range(len(KINDS))])


#: Code points of the pieces in which features look for the context of a candidate.
NEAR = 1024


def pieces_of(text: Column) -> Column:
    """A text in pieces of ``NEAR`` code points, so that the context of a place is found without reading the text up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{NEAR}}}"), F.lit(0))


def features(pieces: Column, s: Column) -> Column:
    """The features of candidate ``s`` of a text, given as ``pieces_of`` it, as a struct of integers."""
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    first, last = F.floor(s["start"] / NEAR).cast("int"), F.floor(s["end"] / NEAR).cast("int")
    among = lambda *kinds: s["kind"].isin([KINDS.index(k) for k in kinds])
    until = (s["start"] - first * NEAR).cast("int")  # code points of its piece before the candidate
    left = F.right(F.concat(piece(first - 1), F.left(piece(first), until)), F.lit(24))
    after = F.substring(F.concat(piece(last), piece(last + 1)), (s["end"] - last * NEAR).cast("int") + 1, F.lit(8))
    right = F.substring(after, 1, 1)
    said = F.substring(s["said"], 1, 96)  # what is longer, a secret, shows its kind in its first characters
    d = _digits(said)
    one = lambda c: F.when(c, 1).otherwise(0)
    values = {
        "kind": s["kind"], "digits": F.length(d), "marks": F.length(F.regexp_replace(said, r"[\p{L}0-9]", "")), "length": F.least(F.length(s["said"]), F.lit(999)),
        "luhn": F.when(among("card", "phone"), one(luhn(d))).otherwise(0), "groups": F.regexp_count(said, F.lit("[0-9]+")), "paren": one(said.contains("(")),
        "before": _edge(F.substring(left, -1, 1)), "after": _edge(right), "cue": one(left.rlike(_CUE)), "against": one(left.rlike(_AGAINST)),
        "date": one(said.rlike(r"^(?:19|20)[0-9]{2}[ .-]|[ .-](?:19|20)[0-9]{2}$")), "sign": one(said.rlike(r"^[2-9]|^\(")),
        "more": one(after.rlike(_MORE)), "led": one(left.rlike(r"[0-9(][ .-]?$")),
        "upper": F.length(F.regexp_replace(said, "[^A-Z]", "")), "lower": F.length(F.regexp_replace(said, "[^a-z]", "")), "distinct": F.size(F.array_distinct(F.split(said, ""))),
        "mod97": F.when(among("iban"), one(mod97(said))).otherwise(0), "named": one(left.rlike(_NAMED)), "hashed": one(left.rlike(_HASHED)),
        "account": one(left.rlike(_ACCOUNT)), "mixed": F.size(F.array_distinct(F.split(F.regexp_replace(said, "[^ ./_-]", ""), ""))),
    }
    return F.struct(*[values[n].cast("int").alias(n) for n in FEATURES])


@dataclass
class Trees:
    """Boosted trees: a leaf is a number, a node (feature, threshold, left, right); thresholds of log-odds by kind."""

    base: float
    trees: list
    accept: dict[str, float]

    def margin(self, x: Column) -> Column:
        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + _case(t, x)
        return total

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:  # in the order in which the expression adds
            total += _leaves(t, x)
        return total


def _case(t, x: Column) -> Column:
    if not isinstance(t, tuple):
        return F.lit(float(t))
    return F.when(x[FEATURES[t[0]]] <= t[1], _case(t[2], x)).otherwise(_case(t[3], x))


def _leaves(t, x: np.ndarray) -> np.ndarray:
    """The leaf that each row reaches."""
    if not isinstance(t, tuple):
        return np.full(len(x), t)
    low = x[:, t[0]] <= t[1]
    out = np.empty(len(x))
    out[low], out[~low] = _leaves(t[2], x[low]), _leaves(t[3], x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 2.0) -> tuple[float, list]:
    """Second-order gradient boosting of logistic loss with exact splits."""
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    margin, out = np.full(len(y), base), []
    values, codes = zip(*[np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])], strict=True)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        for f in range(x.shape[1] if left else 0):
            code = codes[f][rows]
            n, gl, hl = (np.bincount(code, w, len(values[f])) for w in (None, g[rows], h[rows]))
            cuts = np.flatnonzero(n)[:-1]  # after each value that is there but the last
            if len(cuts):
                gl, hl = np.cumsum(gl)[cuts], np.cumsum(hl)[cuts]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, values[f][cuts[k]])
        if best[1] is None:
            return float(-rate * gs / (hs + ridge))
        m = x[rows, best[1]] <= best[2]
        return (int(best[1]), int(best[2]), grow(rows[m], g, h, left - 1), grow(rows[~m], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        t = grow(np.arange(len(y)), p - y, p * (1 - p) + 1e-6, depth)
        out.append(t)
        margin += _leaves(t, x)
    return base, out


def examples(n: int = 4200, seed: int = 7) -> list[tuple[str, str, int]]:
    """Generated (kind, text, label): 1 with personal data, 0 a look-alike."""
    return [(kind, text, int(end > 0)) for kind, text, _, end in _made(n, seed, False)]


def crowded(n: int = 1500, seed: int = 11) -> list[tuple[str, str, int, int]]:
    """Generated (kind, text, start, end) of personal data that other numbers or labels stand next to."""
    return _made(n, seed, True)


def _made(n: int, seed: int, crowd: bool, contexts: list[str] = []) -> list[tuple[str, str, int, int]]:  # noqa: B006
    """Generated (kind, text, start, end), both 0 for a look-alike; contexts: words that may stand before them."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    chars = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexadecimal, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: chars(letters, rng.randint(2, 9))

    def card_number(valid: bool) -> str:
        body = pick("3456") + digits(14)
        check = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, body)))
        last = -check % 10
        return body + str(last if valid else (last + rng.randint(1, 9)) % 10)

    def account(valid: bool) -> str:
        land, body = chars(letters.upper(), 2), pick(["", chars(letters.upper(), 4)]) + digits(rng.randint(11, 22))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        plain = f"{land}{check if valid else (check + rng.randint(1, 90)) % 97 + 2:02}{body}"
        return pick([plain, " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))])

    def grouped(c: str, sep: str) -> str:
        return sep.join(c[k : k + 4] for k in range(0, 16, 4))

    def good(kind: str) -> str:
        if kind == "email":
            name = pick([word(), word() + pick("._-") + word(), pick(letters) + "." + word()])
            at, dot = pick([(pick([" at ", "(at)", " [at] ", " AT ", "{at}", "<at>"]), pick([" dot ", "[dot]", "(dot)", " DOT ", "{dot}"])), (" @ ", pick([" . ", "."]))])
            return name + digits(rng.randint(0, 2)) + at + pick([word(), word() + "-" + word()]) + dot + pick(["com", "org", "de", "net", "io", "info", "co", "fr", "es"])
        if kind == "ip":
            groups = [f"{rng.randrange(65536):x}" for _ in range(8)]
            lo = rng.randint(1, 6)
            return pick([":".join(groups), "2001:db8::" + groups[0], "fe80::" + ":".join(groups[:4]), ":".join(groups[:lo]) + "::" + ":".join(groups[lo + 1 : rng.randint(lo + 1, 7)]), "::ffff:" + groups[0] + ":" + groups[1]])
        if kind == "card":
            return grouped(card_number(True), pick([".", "/", "_", "- "]))
        if kind == "secret":
            mixed = letters + letters.upper() + "0123456789"
            return pick([chars(hexadecimal, pick([32, 40, 64])), chars(mixed, rng.randint(20, 44)) + "7" + pick(["", "="]), "sk-" + chars(mixed, 24) + "3", "ghp_" + chars(mixed, 35) + "1", "AKIA" + chars(letters.upper() + "234567", 15) + "2", chars(mixed + "+/", rng.randint(24, 40)) + "4" + pick(["", "=="])])
        if kind == "iban":
            return account(True)
        if kind == "ssn":
            return f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"
        area = pick(["(" + pick("23456789") + digits(2) + ")", pick("23456789") + digits(2)])
        return area + pick(" -") + pick("2345678") + digits(2) + pick(" -") + digits(4)

    def bad(kind: str) -> str:
        if kind == "email":
            return pick(["look", "meet", "home", "arrive", word()]) + " at " + pick(["noon", "index", "the-end", "school", word()]) + pick([".", " . "]) + pick(["txt", "we", "it", "they", word()])
        if kind == "ip":
            return pick([":".join(digits(2) for _ in range(8)), pick(["std", "abc", "face", "add", "f"]) + "::" + pick(["bad1", "c0", "dec2", "a1"]), "::" + pick(["a1", "f00"])])
        if kind == "card":
            return grouped(card_number(False), pick([".", "/", "_", " ", "- "]))
        if kind == "secret":
            return pick(["-".join(word() for _ in range(4)) + "-20" + digits(2), "_".join(word().upper() for _ in range(3)) + "_" + digits(3), digits(rng.randint(16, 24)), word() + "_" + "0" * 12 + digits(3), "/".join(word() for _ in range(4)) + digits(1), chars(hexadecimal, 40), "-".join([chars(hexadecimal, 8), *(chars(hexadecimal, 4) for _ in range(3)), chars(hexadecimal, 12)])])
        if kind == "iban":
            return account(False)
        if kind == "ssn":
            return pick([f"9{digits(2)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}"])
        return pick([f"20{digits(2)}-07-{digits(2)}", ".".join(digits(2) for _ in range(3)), pick(" -").join(digits(3) for _ in range(4)), " ".join(digits(2) for _ in range(4)), f"{digits(2)}.{digits(3)}.{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}", "-".join([pick("123456789") + digits(3), digits(2), digits(2)])])

    cue = {
        "email": ["mail me: ", "write to ", "contact ", "reach me via "], "ip": ["server ", "host ", "ip addr "], "card": ["card ", "visa ", "my credit card is "], "phone": ["call ", "phone: ", "tel. ", "fax "],
        "secret": ['token = "', "api_key: ", "secret=", "Authorization: Bearer ", "password: ", "AUTH_TOKEN="], "iban": ["iban ", "account ", "pay to "], "ssn": ["ssn ", "social security number ", "ssn: "],
    }
    wrong = {
        "email": ["we ", "they ", "and "], "ip": ["timer ", "code ", "serial "], "card": ["order ", "invoice no ", "ref "], "phone": ["date ", "version ", "total "],
        "secret": ["commit ", "sha256:", "file ", "checksum ", "uuid ", "see https://example.org/"], "iban": ["part ", "serial ", "ref "], "ssn": ["part ", "order ", "ref ", "date "],
    }
    neutral = lambda: pick(contexts) if contexts and rng.random() < 0.5 else pick(["and then ", "of the ", "in ", word() + " " + word() + " "])
    tails = [" today", ". We", ".", ", thanks", "", '"', " " + word()]
    out = []
    for i in range(n * crowd):
        kind = pick(["email", "phone", "phone", "card"])
        lead, said = pick([*cue[kind], neutral()]), good(kind)
        tail = pick(tails)
        if kind == "email":
            at, dot = pick([" at ", "(at)", " [at] ", " (at) "]), pick([".", " dot ", "[dot]", "(dot)", " (dot) ", " [dot] "])
            said = pick(["ann", "bob", "omar", "j.doe", "max", word()]) + digits(rng.randint(0, 2)) + at + dot.join([pick(["mail", "web", "lists", "example", "post-box", "uni", word()]) for _ in range(rng.randint(2 if dot == "." else 1, 4))] + [pick(["com", "org", "de"])])
        else:
            side = rng.randrange(3)
            number = lambda: pick([digits(rng.randint(2, 4)), f"20{digits(2)}", f"19{digits(2)}"])
            if kind == "phone":
                said = pick(["(" + pick("3456") + digits(2) + ")", pick("3456") + digits(2)]) + pick(" -") + pick("2345") + digits(2) + pick(" -") + digits(4)
            if side != 1:
                lead += pick(["", "extension ", "room ", "in ", "no "]) + number() + " "
            if side != 0:
                tail = " " + pick([number(), digits(5)] if kind == "phone" else [number()]) + tail
        lead = "so " + lead
        out.append((kind, lead + said + tail, len(lead), len(lead) + len(said)))
    for i in range(0 if crowd else n):
        kind, label = KINDS[i % len(KINDS)], rng.randrange(2)
        sure = kind == "ssn" or rng.random() < 0.6  # nothing but what stands before tells these numbers
        lead = pick((cue if label else wrong)[kind]) if sure else neutral()
        said = (good if label else bad)(kind)
        if kind == "secret" and not label and set(said) <= set(hexadecimal):
            lead = pick(wrong[kind])  # nothing but what stands before tells these
        lead = "so " + lead
        out.append((kind, lead + said + pick(tails), len(lead) * label, (len(lead) + len(said)) * label))
    return out


def _contexts(docs: DataFrame, n: int) -> list[str]:
    """Words before places in ``n`` documents that a hash of the id chooses, from their first 4,000 code points."""
    d = needs(docs, doc_id="bigint", text="string").where("text is not null and doc_id is not null")
    ids = d.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)  # ids only go to the driver and back
    texts = d.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.substring("text", 1, 4000)).alias("text")).orderBy("doc_id").collect()
    rng, out = random.Random(3), []
    for r in texts:
        said = r["text"].split()
        if len(said) > 4:
            k = rng.randrange(4, len(said))
            out.append(" ".join(said[k - 4 : k])[-60:] + " ")
    return out


def train(spark: SparkSession, docs: DataFrame | None = None, n: int = 4200, precision: float = 0.99, contexts: int = CONTEXTS) -> Trees:
    """Fit the trees on half of the generated examples and set the thresholds on the other half, for the spans that are selected there."""
    around = _contexts(docs, contexts) if docs is not None else []
    made = _made(n, 7, False, around) + _made(n // 2, 11, True, around)
    said = json.dumps([{"id": i, "kind": k, "text": t} for i, (k, t, *_) in enumerate(made)])
    data = spark.range(1).select(F.inline(F.from_json(F.lit(said), "array<struct<id:int,kind:string,text:string>>")))
    found = data.select("id", "text", F.explode(wide(F.col("text"))).alias("s"))
    rows = found.select("id", "s.start", "s.end", features(pieces_of(F.col("text")), F.col("s")).alias("x")).select("id", "start", "end", "x.*").collect()  # a few thousand examples
    rows.sort(key=lambda r: (r["kind"], r["id"], r["start"], r["end"]))
    x, ids = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r["id"] for r in rows])
    y = np.array([made[r["id"]][2:] == (r["start"], r["end"]) and KINDS.index(made[r["id"]][0]) == r["kind"] for r in rows]).astype(int)
    half = ids // len(KINDS) % 2 == 0
    base, trees = boost(x[half], y[half].astype(float))
    model = Trees(base, trees, {})
    margin = model.values(x)
    chosen: dict[tuple[int, int], list[int]] = {}
    for i in sorted(range(len(rows)), key=lambda i: (-margin[i], rows[i]["start"] - rows[i]["end"], rows[i]["start"])):
        own = chosen.setdefault((rows[i]["id"], rows[i]["kind"]), [])
        if all(rows[j]["end"] <= rows[i]["start"] or rows[i]["end"] <= rows[j]["start"] for j in own):
            own.append(i)
    picked = np.zeros(len(rows), bool)
    picked[[i for own in chosen.values() for i in own]] = True
    for k, kind in enumerate(KINDS):
        own = ~half & picked & (x[:, 0] == k)
        order = np.argsort(-margin[own], kind="stable")
        m, hit = margin[own][order], np.cumsum(y[own][order])
        ok = np.flatnonzero((hit / np.arange(1, len(hit) + 1) >= precision) & np.append(m[1:] < m[:-1], True))
        model.accept[kind] = float(max(0.0, m[ok[-1]])) if len(ok) else float("inf")
    return model


def find(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, text and, for each kind, the base spans ``base_<kind>`` and all spans ``all_<kind>``, ordered by start."""
    d = needs(docs, doc_id="bigint", text="string").select("doc_id", text_of().alias("text"))
    text = F.col("text")
    d = d.select("doc_id", "text", *[base_spans(text, k).alias(f"base_{k}") for k in BASE_KINDS], wide(text).alias("_wide"))
    d = d.select("*", F.when(F.size("_wide") > 0, pieces_of(text)).alias("_pieces"))
    # features are worked out once for a candidate, before the trees look at them; all kinds go through one set of trees
    seen = F.transform("_wide", lambda s: F.struct(s.alias("s"), features(F.col("_pieces"), s).alias("x")))
    scored = F.transform(seen, lambda v: F.struct(v["s"].alias("s"), model.margin(v["x"]).alias("margin")))
    least = F.array(*[F.lit(float(model.accept[k])) for k in KINDS])
    d = d.select("*", F.when(F.size("_wide") > 0, F.filter(scored, lambda v: v["margin"] >= F.get(least, v["s"]["kind"]))).alias("_good"))
    d = d.select("*", F.when(F.size("_good") > 0, _chosen(F.col("_good"), F.concat(*[f"base_{k}" for k in BASE_KINDS]))).alias("_added"))

    def every(k: int) -> Column:
        shift = F.lit(k * _APART).cast("bigint")
        own = F.filter(F.coalesce("_added", F.array().cast(_SPANS)), lambda s: (s["start"] >= shift) & (s["start"] < shift + _APART))
        added = F.transform(own, lambda s: F.struct((s["start"] - shift).alias("start"), (s["end"] - shift).alias("end"), s["said"].alias("said")))
        return F.array_sort(F.concat(f"base_{KINDS[k]}", added)) if k < len(BASE_KINDS) else F.array_sort(added)

    return d.select("doc_id", "text", *[f"base_{k}" for k in BASE_KINDS], *[every(k).alias(f"all_{KINDS[k]}") for k in range(len(KINDS))])


#: Kinds are laid so far apart on one line that one selection decides all of them.
_APART = 1 << 40


def _chosen(good: Column, base: Column) -> Column:
    """The accepted spans that stay, on the line of all kinds. What base spans cover goes to none of them: it is laid on
    the line of each kind with a margin above all others."""
    start = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), F.array().cast(_SPANS).alias("out"))
    piece = lambda acc: F.concat(acc["out"], F.when(acc["end"] >= 0, F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"), F.lit(None).cast("string").alias("said")))).otherwise(F.array().cast(_SPANS))).cast(_SPANS)

    def step(acc: Column, s: Column) -> Column:
        joined = F.struct(acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["end"], joined).otherwise(F.struct(s["start"].alias("start"), s["end"].alias("end"), piece(acc).alias("out")))

    covered = fold(F.array_sort(base), start, step, _SPANS, piece)
    laid = lambda s, kind, margin: F.struct(F.struct((s["start"] + kind.cast("bigint") * _APART).alias("start"), (s["end"] + kind.cast("bigint") * _APART).alias("end"), s["said"].alias("said")).alias("s"), margin.alias("margin"))
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.transform(covered, lambda s: laid(s, k, F.lit(1e300)))))
    mine = F.transform(good, lambda v: laid(v["s"], v["s"]["kind"], v["margin"]))
    return F.filter(select(F.concat(mine, blocks)), lambda s: s["said"].isNotNull())


def listed(prefix: str) -> Column:
    """kind:start:end of the columns ``base_<kind>`` or ``all_<kind>``, comma-joined."""
    say = lambda kind: F.transform(f"{prefix}_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[say(k) for k in (BASE_KINDS if prefix == "base" else KINDS)]), ",")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by [EMAIL], [IP], [CARD], [PHONE], [SECRET], [IBAN] or [SSN]; of overlapping spans the first."""
    tagged = lambda kind: F.transform(f"all_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.upper()).alias("kind")))
    every = F.array_sort(F.concat(*[tagged(k) for k in KINDS]))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.concat(kept, F.lit("["), s["kind"], F.lit("]")))).alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(new)

    rest = lambda acc: F.concat(acc["out"], F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return found.select("doc_id", F.array_join(fold(every, start, step, "array<string>", rest), "").alias("text"))
