"""8. Personal data by a skip-chain conditional random field.

Tokens are runs of non-blanks. Words in lower-case letters alone are no entity, so they are observed as O; all other
tokens are variables. Node potentials are log-linear in shapes, check digits and cue words of a token and its
neighbours. Adjacent tokens share a chain potential; tokens of a document that are equal but for case and punctuation
share a skip potential, each occurrence with the next. All weights are learnt jointly by pseudo-likelihood. Loopy belief
propagation over both kinds of edges runs until messages are stable, so labels agree across the document.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textkit import Hasher, parts, runs, word_bytes

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "IBAN", "ID", "NAME")
O, EMAIL, PHONE, CARD, IP, SECRET, IBAN, ID, NAME = range(len(LABELS))
TOGETHER = (PHONE, CARD, IBAN, NAME)  # neighbours with one of these labels are one entity
TRAIN_DOCS, TRAIN_BYTES, LEAST_SCORE = 1500, 8 << 20, 0.5
TOLERANCE, DAMP_AFTER, STOP_AFTER = 1e-3, 60, 2000  # of messages; rounds
EDGE = "\"'([{<|*#$%&!,;:=.?)]}>~`"
#: Labels for training that documents are given, each for whole tokens of the match; earlier ones hold.
WEAK = (
    (PHONE, re.compile(rb"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?!\d)")),
    (EMAIL, re.compile(rb"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")),
    (IP, re.compile(rb"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])")),
    (CARD, re.compile(rb"(?<![\w.])\d{13,19}(?!\w)")),
    (SECRET, re.compile(rb"(?<!\w)(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?!\w)")),
)
CUES = (
    ("name", "mr mrs ms miss dr prof sir name contact signed dear sincerely regards herr frau señor señora monsieur madame attn"),
    ("id", "ssn social security passport license taxpayer"),
    ("card", "card visa mastercard amex credit debit"),
    ("phone", "tel phone call fax mobile telephone cell whatsapp ring"),
    ("plain", "version v release build order invoice no nr number commit sha page room chapter id item code part isbn section"),
    ("key", "token key secret password api_key apikey auth bearer credential"),
    ("bank", "iban account bank"),
)
CUE = {w: kind for kind, words in CUES for w in words.split()}
SHAPES = tuple(
    (name, re.compile(pattern))
    for name, pattern in (
        ("email", r"[\w.+-]+@[\w-]+(\.[\w-]+)*\.[^\W\d_]{2,}"), ("dial", r"(\+|00)\d{1,3}"), ("area", r"\(\d{1,5}\)"), ("d1", r"\d{1,3}"), ("d4", r"\d{4}"), ("d5", r"\d{5,6}"), ("d7", r"\d{7,12}"), ("d13", r"\d{13,19}"), ("d20", r"\d{20,}"),
        ("local", r"\d{3,4}-\d{4}"), ("ssn", r"\d{3}-\d{2}-\d{4}"), ("decimal", r"\d+[.,]\d+%?"), ("date", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), ("hex16", r"(?=.*\d)(?=.*[a-fA-F])[0-9a-fA-F]{16,31}"), ("hex32", r"(?=.*\d)(?=.*[a-fA-F])[0-9a-fA-F]{32,}"),
        ("prefix", r"(AKIA|ASIA)[0-9A-Z]{12,}|(gh[a-z]|sk|pk|rk|xox[a-z]|glpat|npm|hf|pat|key)[_-]\w[\w-]{14,}|AIza[\w-]{20,}|eyJ[\w-]{8,}\.[\w.-]{8,}"), ("mixed", r"(?=.*\d)(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"), ("country", r"[A-Z]{2}\d{2}"),
    )
)
FLAGS = ("at", "plus", "grouped7", "grouped13", "luhn", "quad", "v6", "iban", "quoted", "title", "caps", "digits", "other", "long", "luhn_run", "iban_run", *(f"cue_{k}" for k, _ in CUES))
NAMES = (*(n for n, _ in SHAPES), *FLAGS)
BIT = {n: np.uint64(1 << i) for i, n in enumerate(NAMES)}
BEFORE = ("dial", "area", "d1", "d4", "plus", "title", "country", "grouped7", *(f"cue_{k}" for k, _ in CUES))  # what counts of the token before, and of the one before that
AFTER = ("area", "d1", "d4", "d5", "local", "title", "luhn_run")
N_FEATURES = 1 + len(NAMES) + 2 * len(BEFORE) + len(AFTER)


def blanks() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


BLANK = blanks()
OPEN = np.zeros(256, np.uint8)  # what makes a token a variable: digits, capitals, @ : _ and the like; letters and edge marks don't
OPEN[[*range(48, 58), *range(65, 91), 64, 43, 95]] = 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_iban(text: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def mark(raw: bytes) -> int:
    """Bits of NAMES that a token has by itself."""
    whole = raw.decode("utf-8", "replace")
    token = whole.strip(EDGE) if not re.match(r"[\"'*#\[{<]*\(\d{1,5}\)", whole) else whole.strip("\"'*#[]{}<>,;:.!?")
    out, kind = 0, CUE.get(token.lower())
    if kind:
        out |= int(BIT[f"cue_{kind}"])
    for name, pattern in SHAPES:
        if pattern.fullmatch(token):
            out |= int(BIT[name])
    digits = sum(c.isdigit() for c in token)
    add = lambda name, so: int(BIT[name]) if so else 0
    letters = any(c.isalpha() for c in token)
    plain = digits and not letters and re.fullmatch(r"[+\d().\-/]+", token)
    figures = re.sub(r"\D", "", token) if plain else ""
    separated = bool(plain) and bool(re.search(r"\d[-./()]+\d", token)) and not re.fullmatch(r"\d+[.,]\d+", token)
    out |= add("at", "@" in token) | add("plus", token.startswith("+") and digits >= 7)
    out |= add("grouped7", separated and 7 <= len(figures) <= 12) | add("grouped13", separated and 13 <= len(figures) <= 19)
    out |= add("luhn", 13 <= len(figures) <= 19 and luhn(figures))
    out |= add("quad", bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", token)) and all(int(x) < 256 for x in token.split(".")))
    if 2 <= token.count(":") <= 8 and len(token) < 50:
        try:
            out |= add("v6", ipaddress.ip_address(token).version == 6)
        except ValueError:
            pass
    out |= add("iban", len(token) < 40 and is_iban(token)) | add("quoted", whole[:1] in "\"'" and whole[:1] != "")
    word = token.replace("-", "").replace("'", "")
    out |= add("title", word.isalpha() and token[:1].isupper() and not token.isupper()) | add("caps", word.isalpha() and token.isupper() and len(token) > 1)
    return out | add("digits", digits > 0) | add("other", digits > 0 and letters) | add("long", len(token) >= 30)


class Reader:
    """Variables of a chunk of texts, their features and edges. Marks of tokens are remembered for a task."""

    def __init__(self):
        self.known, self.hasher, self.plain_cues = {}, Hasher(5), {w.encode() for w in CUE}
        folded = np.arange(256, dtype=np.uint8)
        folded[65:91] += 32
        self.keep = word_bytes()
        self.hasher.table = np.where(self.keep, self.hasher.table[folded], np.uint64(0))  # punctuation adds nothing

    def marks(self, data, starts, ends) -> np.ndarray:
        """Own bits of every token; plain words have none but those of cues."""
        n = len(starts)
        bits = np.zeros(n, np.uint64)
        if not n:
            return bits
        bounds = np.stack((starts, ends), 1).ravel()
        # hexadecimal groups with colons need no digit, so a colon inside counts too
        flags = OPEN[data]
        inner = np.flatnonzero(data == 58)
        inner = inner[(inner > 0) & (inner + 1 < len(data))]
        flags[inner[~BLANK[data[inner - 1]] & ~BLANK[data[np.minimum(inner + 1, len(data) - 1)]]]] = 1
        odd = np.maximum.reduceat(np.concatenate((flags, [0])), bounds)[::2] > 0
        short = (ends - starts <= 14) & ~odd
        for i in np.flatnonzero(odd).tolist():
            bits[i] = self.mark(data[starts[i] : ends[i]].tobytes())
        size = ends - starts
        keys = self.hasher(data, starts, ends)
        cue = np.flatnonzero(short & np.isin(keys, self.cue_keys()))
        for i in cue.tolist():
            bits[i] = self.mark(data[starts[i] : ends[i]].tobytes())
        self.odd, self.keys, self.size = odd, keys, size
        return bits

    def cue_keys(self):
        if not hasattr(self, "_cue_keys"):
            text = b" ".join(sorted(self.plain_cues))
            at = np.frombuffer(text, np.uint8)
            s, e, _ = runs(~BLANK[at], np.array([0, len(at)]))
            self._cue_keys = self.hasher(at, s, e)
        return self._cue_keys

    def mark(self, raw: bytes) -> int:
        if len(raw) > 64:
            return mark(raw)
        got = self.known.get(raw)
        if got is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            got = self.known[raw] = mark(raw)
        return got

    def read(self, data, offsets):
        """(starts, ends, owner, variables, features, ties, chain, skip): token bounds; indices of the variables; their
        feature rows; whether a plain word stands before and after (else a variable or nothing); edges among variables."""
        starts, ends, owner = runs(~BLANK[data], offsets)
        bits = self.marks(data, starts, ends)
        n = len(starts)
        if not n:
            none = np.zeros((0, 2), np.int64)
            return starts, ends, owner, np.zeros(0, np.int64), np.zeros((0, N_FEATURES), np.float32), np.zeros((0, 2), bool), none, none
        self._runs(data, starts, ends, owner, bits)
        var = np.flatnonzero(self.odd)
        padded = np.concatenate((np.zeros(2, np.uint64), bits, np.zeros(1, np.uint64)))
        whose = np.concatenate(([-1, -1], owner, [-1]))

        def near(step):
            return np.where(whose[var + 2 + step] == owner[var], padded[var + 2 + step], np.uint64(0))

        cols = [np.ones(len(var), bool)]
        own, one, two, after = bits[var], near(-1), near(-2), near(1)
        cols += [(own & BIT[x]) > 0 for x in NAMES] + [(one & BIT[x]) > 0 for x in BEFORE] + [(two & BIT[x]) > 0 for x in BEFORE] + [(after & BIT[x]) > 0 for x in AFTER]
        x = np.stack(cols, 1).astype(np.float32)
        odd = np.concatenate((self.odd, [False]))
        same = np.concatenate((owner[1:] == owner[:-1], [False]))  # with the next token
        place = np.cumsum(self.odd) - 1
        linked = np.flatnonzero(same & odd[:-1] & odd[1:])
        chain = np.stack((place[linked], place[np.minimum(linked + 1, n - 1)]), 1)
        before = np.concatenate(([False], same[:-1])) & ~np.concatenate(([False], odd[:-2]))
        ties = np.stack((before, same & ~odd[1:]), 1)[var]
        return starts, ends, owner, var, x, ties, chain, self._skips(data, starts, ends, owner, var)

    def _skips(self, data, starts, ends, owner, var):
        """Each variable and the next one of its document that is equal but for case and punctuation."""
        if len(var) < 2:
            return np.zeros((0, 2), np.int64)
        first = _first_kept(self.keep[data], starts[var], ends[var])
        key = self.hasher(data, first, ends[var])
        full = np.add.reduceat(np.concatenate((self.keep[data], [False])).astype(np.int64), np.stack((starts[var], ends[var]), 1).ravel())[::2] > 0
        at = np.flatnonzero(full)
        order = at[np.lexsort((at, key[at], owner[var[at]]))]
        a, b = order[:-1], order[1:]
        same = (key[a] == key[b]) & (owner[var[a]] == owner[var[b]])
        return np.stack((a[same], b[same]), 1)

    def _runs(self, data, starts, ends, owner, bits):
        """Groups over several tokens with a right check digit: four times four figures, and an account number."""
        is4 = (bits & BIT["d4"]) > 0
        n = len(bits)
        if n >= 4:
            at = np.flatnonzero(is4[:-3] & is4[1:-2] & is4[2:-1] & is4[3:] & (owner[:-3] == owner[3:]))
            last = -4
            for i in at.tolist():
                if i >= last + 4 and luhn(re.sub(rb"\D", b"", data[starts[i] : ends[i + 3]].tobytes()).decode()):
                    bits[i : i + 4] |= BIT["luhn_run"]
                    last = i
        for i in np.flatnonzero((bits & BIT["country"]) > 0).tolist():
            j, text = i, ""
            while j < n and j < i + 9 and owner[j] == owner[i]:
                piece = data[starts[j] : ends[j]].tobytes().decode("utf-8", "replace").strip(EDGE)
                if not (piece.isalnum() and piece.isascii() and len(piece) <= 4):
                    break
                text += piece
                j += 1
                if is_iban(text) and (j == n or owner[j] != owner[i] or len(text) >= 22 or len(piece) < 4):
                    bits[i:j] |= BIT["iban_run"]
                    break


def _first_kept(keep, starts, ends):
    where = np.flatnonzero(keep)
    if not len(where):
        return starts
    at = np.minimum(np.searchsorted(where, starts), len(where) - 1)
    return np.where((where[at] >= starts) & (where[at] < ends), where[at], starts)


def _normed(x):
    x = x / x.sum(1, keepdims=True)
    return x


def infer(unary, owner, chain_edges, skip_edges, chain, skip, tolerance=TOLERANCE):
    """Marginals (variables x labels) by belief propagation on chain and skip edges (pairs of variables, the earlier one
    first). Documents whose messages changed by less than ``tolerance`` rest; those that go on for long are damped."""
    n, k = unary.shape
    logu = np.log(np.maximum(unary, 1e-30)).astype(np.float64)
    edges = np.concatenate((chain_edges, skip_edges)).astype(np.int64).reshape(-1, 2)
    m = len(edges)
    if not m:
        return _normed(np.exp(logu - logu.max(1, keepdims=True)))
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
    is_chain = np.arange(m) < len(chain_edges)
    kind = np.concatenate((np.where(is_chain, 0, 2), np.where(is_chain, 1, 3)))
    tables = (chain, chain.T, skip, skip.T)
    msg = np.full((2 * m, k), -np.log(k))
    belief = np.zeros((n, k))

    def believe(active):
        for j in range(k):
            belief[:, j] = np.bincount(dst[active], msg[active, j], n)
        np.add(belief, logu, out=belief)

    active, rounds = np.arange(2 * m), 0
    while len(active) and rounds < STOP_AFTER:
        believe(active)
        pre = belief[src[active]] - msg[back[active]]
        pre = np.exp(pre - pre.max(1, keepdims=True))
        new = np.empty_like(pre)
        for t, table in enumerate(tables):
            own = kind[active] == t
            if own.any():
                new[own] = pre[own] @ table
        new /= new.sum(1, keepdims=True)
        if rounds >= DAMP_AFTER:
            new = 0.5 * new + 0.5 * np.exp(msg[active])
        change = np.abs(new - np.exp(msg[active])).max(1)
        msg[active] = np.log(np.maximum(new, 1e-30))
        moving = np.zeros(int(owner.max()) + 1, bool)
        moving[owner[src[active[change > tolerance]]]] = True
        active = active[moving[owner[src[active]]]]
        rounds += 1
    believe(np.arange(2 * m))
    return _normed(np.exp(belief - belief.max(1, keepdims=True)))


def potentials(model, x, ties):
    """Node potentials, with what plain neighbours (observed as O) add to them."""
    z = x @ model["w"] + ties[:, :1] * model["t"][O][None] + ties[:, 1:] * model["t"][:, O][None]
    return np.exp(z - z.max(1, keepdims=True)) + 1e-9


def weak_labels(data, starts, ends):
    text, out = data.tobytes(), np.zeros(len(starts), np.int64)
    for label, pattern in WEAK:
        for m in pattern.finditer(text):
            lo, hi = np.searchsorted(ends, m.start(), "right"), np.searchsorted(starts, m.end(), "left")
            span = out[lo:hi]
            span[span == 0] = label
    return out


def with_check(digits: str) -> str:
    """Digits and their check digit."""
    return next(digits + str(i) for i in range(10) if luhn(digits + str(i)))


def an_iban(country: str, rest: str) -> str:
    n = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - n % 97:02}{rest}"


def seeds(n=400, seed=3) -> list[tuple[list[str], list[int]]]:
    """Generated lines of tokens with labels: every kind of entity in several forms, in prose or one after the other as in
    a record, and numbers, codes and capital words that are none. Some things are repeated later in their line, from
    which the skip weights learn that copies agree, those outside entities too."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9)))
    name = lambda: word().capitalize()
    pick = lambda *x: x[r.integers(0, len(x))]
    alnum = lambda k, s="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(s[i] for i in r.integers(0, len(s), k))
    four = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    octet = lambda: str(r.integers(0, 256))
    hexes = lambda k: f"{r.integers(0, 1 << 16):x}" + "".join(f":{r.integers(0, 1 << 16):x}" for _ in range(k - 1))
    iban = lambda: an_iban(*pick(("DE", d(18)), ("FR", d(23)), ("ES", d(20)), ("NL", "ABNA" + d(10))))
    cue = {k: w.split() for k, w in CUES}
    entities_ = [
        lambda: (EMAIL, f"{word()}.{d(2)}@{word()}.{word()}.com"), lambda: (EMAIL, f"{word()}@{word()}.org"), lambda: (PHONE, f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"), lambda: (PHONE, f"{pick(*cue['phone'])}| {d(3)}-{d(3)}-{d(4)}"), lambda: (PHONE, f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"),
        lambda: (PHONE, f"+{d(2)} {d(2)} {d(4)} {d(4)}"), lambda: (PHONE, f"+{d(2)} {d(3)} {d(3)} {d(4)}"), lambda: (PHONE, f"+{d(12)}"), lambda: (PHONE, f"({d(3)}) {d(3)}-{d(4)}"), lambda: (CARD, with_check("4" + d(14))), lambda: (CARD, "4" + d(15)), lambda: (CARD, "5" + d(15)), lambda: (CARD, four(with_check("5" + d(14)))), lambda: (CARD, four(with_check("4" + d(14))).replace(" ", "-")),
        lambda: (IP, ".".join(octet() for _ in range(4))), lambda: (IP, hexes(8)), lambda: (IP, f"{hexes(3)}::{hexes(2)}"), lambda: (SECRET, f'{pick(*cue["key"])} =| "{r.bytes(20).hex()}"'), lambda: (SECRET, r.bytes(16).hex()), lambda: (SECRET, r.bytes(32).hex().upper()), lambda: (SECRET, "AKIA" + alnum(16).upper()), lambda: (SECRET, pick("ghp_", "sk_", "xoxb-") + alnum(32)),
        lambda: (SECRET, f"{pick(*cue['key'])}:| {alnum(28)}7aB"), lambda: (IBAN, iban()), lambda: (IBAN, four(iban())), lambda: (ID, f"{pick(*cue['id'])}| {d(3)}-{d(2)}-{d(4)}"), lambda: (ID, f"{d(3)}-{d(2)}-{d(4)}"), lambda: (NAME, f"{pick(*cue['name'])}:| {name()} {name()}"), lambda: (NAME, f"{pick('Mr.', 'Mrs.', 'Dr.', 'Prof.', 'Herr', 'Frau')}| {name()}"),
    ]
    others = [
        lambda: d(1), lambda: d(2), lambda: d(3), lambda: d(4), lambda: d(5), lambda: f"{d(4)} {d(4)}", lambda: f"{d(1)}.{d(2)}", lambda: f"{d(3)}-{d(2)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}", lambda: f"{pick('version', 'release', 'v')} {octet()}.{octet()}.{octet()}.{octet()}", lambda: f"{pick('order', 'invoice', 'item')} {d(16)}", lambda: f"{pick('commit', 'sha')} {r.bytes(20).hex()}",
        name, name, lambda: f"{name()} {name()}", lambda: word().upper(), lambda: f"{word()}{d(2)}", lambda: f"{word().upper()}-{d(3)}", lambda: f"{pick('room', 'page', 'no', 'number')} {d(4)}", lambda: alnum(6), lambda: f"{d(1)}:{d(2)}", lambda: f"@{word()}", lambda: f"{d(7)}", lambda: f"{d(10)}", lambda: f"{word()}_{word()}",
    ]
    out = []
    for i in range(n):
        tokens, labels = [], []

        def put(label, text, times=1):
            for _ in range(times):
                lead, _, body = text.rpartition("|")
                for label_, part in ((O, lead), (label, body)):
                    for t in part.split():
                        tokens.append(t)
                        labels.append(label_)
                if r.random() < 0.15:
                    tokens[-1] += pick(".", ",", "!", "&&&")

        def prose(k):
            for _ in range(k):
                put(O, word() if r.random() < 0.85 else name())

        again = []
        for j in range(10):
            if i % 3:
                prose(r.integers(1, 5))
            label, text = pick(*entities_)() if r.random() < 0.5 else (O, pick(*others)())
            put(label, text, 1 if r.random() < 0.9 else int(r.integers(2, 5)))
            again.append((label, text.rpartition("|")[2]))
        for j in r.permutation(len(again))[:4]:
            prose(r.integers(1, 4))
            put(*again[j])
        out.append((tokens, labels))
    return out


def fit(x, before, after, near, y, weight, steps=1000, rate=2.0, l2=(2e-5, 1e-4)):
    """Weights by pseudo-likelihood: each variable's label given its features, the labels beside it and the counts of
    labels at the ends of its skip edges. Rows are distinct, ``weight`` their multiplicities. ``before`` and ``after``:
    labels, -1 where there is no token. One table serves both directions of the chain; that of skips is symmetric."""
    k, f = len(LABELS), x.shape[1]
    eye = np.vstack((np.eye(k), np.zeros((1, k))))
    p, q, target = eye[before], eye[after], np.eye(k)[y]
    share = np.sqrt(weight)
    share = (share / share.sum())[:, None]
    w = [np.zeros((f, k)), np.zeros((k, k)), np.zeros((k, k))]
    v = [a.copy() for a in w]
    for _ in range(steps):
        look = [a + 0.9 * b for a, b in zip(w, v)]
        z = x @ look[0] + p @ look[1] + q @ look[1].T + near @ look[2]
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - target) * share
        s = near.T @ g
        grads = (x.T @ g + l2[0] * look[0], p.T @ g + (q.T @ g).T + l2[1] * look[1], (s + s.T) / 2 + l2[1] * look[2])
        v = [0.9 * b - rate * d for b, d in zip(v, grads)]
        w = [a + b for a, b in zip(w, v)]
    return w


def rows_of(reader, data, offsets, labels):
    """Training rows of a chunk: features, labels before and after, counts at skip edges, labels."""
    starts, ends, owner, var, x, ties, _chain, skip = reader.read(data, offsets)
    y = labels(data, starts, ends)
    y[~reader.odd] = O
    same = owner[1:] == owner[:-1]
    before, after = np.full(len(y), -1), np.full(len(y), -1)
    before[1:][same], after[:-1][same] = y[:-1][same], y[1:][same]
    near = np.zeros((len(var), len(LABELS)))
    own = y[var]
    np.add.at(near, (skip[:, 0], own[skip[:, 1]]), 1)
    np.add.at(near, (skip[:, 1], own[skip[:, 0]]), 1)
    return np.concatenate((x, before[var][:, None], after[var][:, None], near, own[:, None]), 1).astype(np.float32)


def learn(texts: list[str], lines=None) -> dict:
    """The model from texts, labelled by patterns, and generated lines."""
    reader, rows = Reader(), []
    for _a, _b, data, offsets in parts(pa.array(texts, pa.large_string())):
        rows.append(rows_of(reader, data, offsets, weak_labels))
    for tokens, labels in seeds() if lines is None else lines:
        data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
        rows.append(np.repeat(rows_of(reader, data, np.array([0, len(data)]), lambda *_, y=labels: np.array(y)), 1, 0))
    every, count = np.unique(np.concatenate(rows), axis=0, return_counts=True)
    f, k = N_FEATURES, len(LABELS)
    w, t, s = fit(every[:, :f].astype(np.float64), every[:, f].astype(int), every[:, f + 1].astype(int), every[:, f + 2 : f + 2 + k].astype(np.float64), every[:, -1].astype(int), count)
    return {"w": w.astype(np.float32), "t": t.astype(np.float32), "chain": np.exp(t), "skip": np.exp(s)}


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> dict:
    """A model from generated lines and a hash sample of at most ``train_docs`` rows and ``train_bytes`` bytes of text,
    labelled by patterns. Rows that repeat are sampled once."""
    keyed = docs.filter("text is not null").select(F.xxhash64("text", F.lit("pii")).alias("key"), F.octet_length("text").cast("long").alias("size"))
    first = keyed.filter(F.col("size") <= train_bytes).distinct().orderBy("key").limit(train_docs)
    so_far = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    keys = first.withColumn("so_far", so_far).filter(F.col("so_far") <= train_bytes).select("key")
    own = docs.filter("text is not null").select(F.xxhash64("text", F.lit("pii")).alias("key"), "text").join(F.broadcast(keys), "key", "left_semi")
    return learn([r[0] for r in own.groupBy("key").agg(F.first("text").alias("text")).orderBy("key").select("text").collect()])


def entities(model, data, offsets, least=LEAST_SCORE, reader=None):
    """(document, start, end, label, score) of each entity; neighbours with one label of TOGETHER are one entity. Offsets
    are characters of the document, surrounding punctuation is left out."""
    reader = reader or Reader()
    starts, ends, owner, var, x, ties, chain, skip = reader.read(data, offsets)
    if not len(var):
        return []
    p = infer(potentials(model, x, ties), owner[var], chain, skip, model["chain"], model["skip"])
    best = p.argmax(1)
    hits = np.flatnonzero((best > 0) & (p.max(1) >= least))
    if not len(hits):
        return []
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out = []
    for j in hits.tolist():
        i, label, score = int(var[j]), int(best[j]), float(p[j, best[j]])
        if out and label in TOGETHER and out[-1][5] == i - 1 and out[-1][3] == label and out[-1][0] == owner[i] and not (label == PHONE and data[starts[i]] == 43) and not _closed(data, starts[i - 1], ends[i - 1], label):
            out[-1] = [owner[i], out[-1][1], int(ends[i]), label, min(score, out[-1][4]), i]
        else:
            out.append([owner[i], int(starts[i]), int(ends[i]), label, score, i])
    done = []
    for d, s, e, label, score, _ in out:
        raw = data[s:e].tobytes()
        left = len(raw) - len(raw.lstrip(b"\"'([{<|*#$%&!,;:=" if label != PHONE else b"\"'[{<|*#$%&!,;:="))
        right = len(raw.rstrip(b"\"')]}>|*#$%&!,;:.?="))
        s, e = s + left, s + max(left + 1, right)
        done.append((int(d), int(chars[s] - chars[offsets[d]]), int(chars[min(e, len(data))] - chars[offsets[d]]), LABELS[label], round(score, 4)))
    return done


def _closed(data, start, end, label) -> bool:
    """Whether a token ends its entity: a comma or the like, or all figures of a card or account."""
    if data[end - 1] in b",;!?" or data[end - 1] == 46 and label != NAME:
        return True
    return label == CARD and int(((data[start:end] >= 48) & (data[start:end] <= 57)).sum()) >= 13 or label == IBAN and end - start >= 15


def _tag(shipped, least):
    def run(batches):
        model, reader = shipped.value, Reader()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[a + d], *x) for a, _b, data, offsets in parts(batch.column("text")) for d, *x in entities(model, data, offsets, least, reader)]
            if rows:
                doc, s, e, label, score = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "start", "end", "label", "score"])

    return run


def find_pii(docs: DataFrame, train_docs: int = TRAIN_DOCS, least_score: float = LEAST_SCORE, model: dict | None = None) -> DataFrame:
    """Entities of all documents: (doc_id, start, end, label, score).

    ``start`` and ``end`` count characters. ``score`` is the lowest marginal of the entity's tokens. Null and empty
    texts have no entities; a null id stays null; repeated rows give their entities again. Extra columns are ignored.
    An empty table gives no rows (the model then comes from generated lines alone). Texts may be of any length.
    """
    model = train(docs, train_docs) if model is None else model
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_tag(shipped, least_score), "doc_id long, start long, end long, label string, score double")
