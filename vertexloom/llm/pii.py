"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) come from fixed rules. Beyond them, generators with high recall propose spans that may
overlap: numbers that could be telephones, social security numbers, bank accounts, hardware or IPv6 addresses, secrets, and
spelled-out mail addresses. Boosted trees score each from its format (length, digits, separators, entropy, checksums) and its
context (words before it, neighbouring characters); scores are calibrated on held-out candidates, and each kind has the
lowest threshold that reaches PRECISION there. Of overlapping selected spans the likeliest stays; spans that overlap a base
span give way to it.

There are no labels for personal data, so the trees are fitted on drawn examples: true items and look-alikes (order numbers,
versions, prices, dates, hashes of builds) in invented context. The draw is seeded and of fixed size, and never sees the corpus.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.batches import short_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "ssn", "iban", "secret", "spelled", "address")
KINDS = BASE + ADDED
PRECISION = 0.95
EXAMPLES = 6000
TREES, DEPTH, RATE = 60, 3, 0.2
CONTEXT = 32

# --- base rules -------------------------------------------------------------------------------------------------------
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match's first digit run is taken whole, so a match can't begin inside a run: the look-behind only saves retries
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the local part is all that can stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidates and features ------------------------------------------------------------------------------------------
_GENERATORS = (
    ("number", re.compile(r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?(?:[ ./-]?[0-9]{2,5}){2,4}(?![0-9A-Za-z])"), _DIGIT),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"), _DIGIT),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"), _DIGIT),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+.~@-])[A-Za-z0-9_/+~-][A-Za-z0-9_/+.~-]{18,}[A-Za-z0-9_/+]={0,2}"), _DIGIT),
    ("address", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), re.compile(r":[0-9A-Fa-f]{1,4}:")),
    ("spelled", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?[(\[{]dot[)\]}] ?| dot |\.)|(?<= )at(?= ) [A-Za-z0-9-]{1,63}(?: ?[(\[{]dot[)\]}] ?| dot ))[A-Za-z]{2,10}(?![A-Za-z0-9])", re.I), re.compile(r"[(\[{ ]at[)\]} ]", re.I)),
)
#: Words beside personal data, and beside other numbers, in English, French, German and Spanish.
GOOD = """phone tel call mobile cell fax whatsapp ssn social iban account bank token key secret password api mail email contact reach
write mac host card téléphone appelez portable compte banque clé jeton courriel contactez écrire hôte carte telefon handy anrufen
rufnummer konto kontonummer schlüssel passwort geheim kontakt schreiben adresse karte teléfono llamar móvil cuenta banco clave
contraseña secreto correo contacto escribir tarjeta""".split()
BAD = """order version isbn price total page section invoice commit build year chapter item sku id ref part no released at commande prix
facture année chapitre article réf numéro publié bestellung preis seite rechnung jahr kapitel artikel nummer vom pedido precio
página factura año capítulo artículo número publicado""".split()
_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[A-Za-z]")
_LOWER = re.compile(r"[a-z]+")
FEATURES = len(ADDED) + 21


def _formed(kind: str, span: str) -> bool:
    """What the patterns don't say: telephone numbers have 7 to 15 digits, secrets a digit and a letter."""
    if kind == "number":
        return 7 <= sum(c.isdigit() for c in span) <= 15
    return kind != "secret" or bool(_DIGIT.search(span) and _LETTER.search(span))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping proposals of all generators."""
    return [(m.start(), m.end(), kind) for kind, pattern, gate in _GENERATORS if gate.search(text) for m in pattern.finditer(text) if _formed(kind, m[0])]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span."""
    s, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    counts = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    words = _WORD.findall(before)
    prev, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    check = luhn("".join(c for c in s if c in "0123456789")) if kind == "number" else _mod97(s) if kind == "iban" else kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9"
    return [
        *(float(kind == k) for k in ADDED),
        len(s), digits, letters, len(s) - digits - letters, len(counts), entropy, float(check),
        sum(w in _GOOD for w in words), sum(w in _BAD for w in words), float(bool(words) and words[-1] in _GOOD), float(bool(words) and words[-1] in _BAD),
        float(prev in "=:\"'"), float(prev in "$€#v/"), float(after in "%$€"), float("=" in before[-6:]), max(groups, default=0), min(groups, default=0), len(groups), sum(c.isupper() for c in s),
        max((len(x) for x in _LOWER.findall(s)), default=0), sum(c in "/.-" for c in s),
    ]


# --- drawn examples ---------------------------------------------------------------------------------------------------
def _examples(n: int, seed: int) -> Iterator[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label): spans that the generators propose in drawn sentences."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice(string.digits) for _ in range(k))
    low = lambda k: "".join(rnd.choice(string.ascii_lowercase) for _ in range(k))
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    filler = lambda: " ".join(low(rnd.randint(2, 9)) for _ in range(rnd.randint(2, 6)))

    def iban() -> str:
        land, body = rnd.choice(["DE", "FR", "ES", "GB"]), num(18)
        rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{98 - rest:02d}{body}"

    base64 = lambda k: "".join(rnd.choice(string.ascii_letters + string.digits + "/+") for _ in range(k))
    path = lambda: "/".join(low(rnd.randint(3, 9)) for _ in range(rnd.randint(3, 6)))
    call = ["call", "phone", "tel", "mobile:", "fax", "téléphone", "appelez", "portable", "telefon", "anrufen", "handy:", "teléfono", "llamar", "móvil"]
    pay = ["iban", "bank account", "pay to", "compte", "konto", "kontonummer", "cuenta", ""]
    hide = ["token =", "api_key =", "secret:", "password =", "key=", "clé :", "jeton", "schlüssel:", "passwort =", "clave:", "contraseña =", "token:"]
    post = ["mail", "write to", "contact", "email:", "courriel", "écrire", "kontakt", "schreiben", "correo", "contacto", ""]
    true = [
        lambda: (rnd.choice(call), f"({num(3)}) {num(3)}-{num(4)}"),
        lambda: (rnd.choice([*call, ""]), f"{num(3)}-{num(3)}-{num(4)}"),
        lambda: (rnd.choice(call), f"0{num(2)} {num(4)} {num(4)}"),
        lambda: (rnd.choice(["ssn", "social security", "ssn:", ""]), f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"),
        lambda: (rnd.choice(pay), (lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rnd.random() < 0.5 else s)(iban())),
        lambda: (rnd.choice(hide), rnd.choice(['"', "", "'"]) + rnd.choice([hexes(40), hexes(32), hexes(rnd.randint(64, 200)), hexes(40).upper(), "AKIA" + num(6) + low(14).upper(), "ghp_" + low(12) + num(12) + low(12)])),
        lambda: (rnd.choice(hide), rnd.choice(['"', "", "'"]) + rnd.choice([base64(39) + "7", base64(rnd.randint(60, 200)) + "9=", f"ey{base64(18)}3.ey{base64(24)}.{base64(30)}8"])),
        lambda: (rnd.choice(post), f"{low(5)}{rnd.choice([' at ', ' (at) ', '[at]', ' [at] '])}{low(6)}{rnd.choice([' dot ', '(dot)', ' [dot] '])}{rnd.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"),
        lambda: (rnd.choice(["mac", "host", "address", "hôte", "adresse", ""]), ":".join(hexes(2) for _ in range(6)) if rnd.random() < 0.5 else ":".join(hexes(4) for _ in range(8))),
    ]
    false = [
        lambda: (rnd.choice(["order", "invoice no", "item", "ref", "sku", "id", "commande", "facture", "bestellung", "rechnung", "pedido", "factura", "número"]), num(rnd.randint(7, 15))),
        lambda: ("", num(rnd.randint(7, 15))),
        lambda: (rnd.choice(["version", "build", "released", "publié", "vom"]), f"{num(2)}.{num(2)}.{num(3)}"),
        lambda: (rnd.choice(["on", "released", "year", "année", "jahr", "año", ""]), f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"),
        lambda: (rnd.choice(["isbn", "page", "section", "seite", "página", "chapitre"]), f"978-{num(2)}-{num(4)}-{num(3)}"),
        lambda: (rnd.choice(["order", "part no", "ref", "réf", "pedido"]), f"9{num(2)}-{num(2)}-{num(4)}"),
        lambda: (rnd.choice(["part", "sku", "item", "artikel", "artículo"]), f"{low(2).upper()}{num(2)} {num(4)} {num(4)}"),
        lambda: (rnd.choice(["total", "price", "prix", "preis", "precio", ""]), f"{num(3)} {num(3)} {num(3)}"),
        lambda: (rnd.choice(["commit", "build", "see", "file", ""]), low(14) + "_" + low(8) + num(2)),
        lambda: (rnd.choice(["see", "file", "at", "from", ""]), f"/{path()}/{num(4)}/{low(6)}.{low(3)}"),
        lambda: (rnd.choice(["see", "from", ""]), f"{low(6)}.{low(8)}.com/{path()}/{num(2)}"),
        lambda: (rnd.choice(["a", "the", ""]), "-".join(low(rnd.randint(3, 8)) for _ in range(4)) + f"-{num(rnd.randint(1, 4))}"),
        lambda: (rnd.choice(["we met", "look", "stay"]), f"{low(5)} at {low(4)} dot {low(3)}"),
        lambda: (rnd.choice(["at", "from", ""]), ":".join(num(2) for _ in range(5))),
    ]
    for _ in range(n):
        label = rnd.random() < 0.5
        lead, item = rnd.choice(true if label else false)()
        left = f"{filler()} {lead} ".replace("  ", " ") if item[:1] not in "\"'" else f"{filler()} {lead} "
        text = f"{left}{item}{rnd.choice([' ', '. ', ', '])}{filler()}"
        for a, b, kind in candidates(text):
            if a < len(left) + len(item) and b > len(left):
                yield text, a, b, kind, int(label)


# --- boosted trees ----------------------------------------------------------------------------------------------------
def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple:
    """(feature, threshold, left, right) or (value,): Newton gain over quantile thresholds."""
    leaf = (float(grad.sum() / (hess.sum() + 1.0)),)
    if depth == 0 or len(x) < 20:
        return leaf
    best, total = (1e-6, -1, 0.0), grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))):
            go = x[:, f] <= cut
            if 5 <= go.sum() <= len(x) - 5:
                gl, hl = grad[go].sum(), hess[go].sum()
                gain = gl**2 / (hl + 1.0) + (grad.sum() - gl) ** 2 / (hess.sum() - hl + 1.0) - total
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] < 0:
        return leaf
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[go], grad[go], hess[go], depth - 1), _tree(x[~go], grad[~go], hess[~go], depth - 1)


def _walk(tree: tuple, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += RATE * tree[0]
        return
    go = x[rows, tree[0]] <= tree[1]
    _walk(tree[2], x, out, rows[go])
    _walk(tree[3], x, out, rows[~go])


def _margin(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        _walk(t, x, out, np.arange(len(x)))
    return out


class Model:
    """Boosted trees, Platt calibration (a, b), and a threshold for each added kind."""

    def __init__(self, trees: list[tuple], a: float, b: float, thresholds: dict[str, float]):
        self.trees, self.a, self.b, self.thresholds = trees, a, b, thresholds

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * _margin(self.trees, x) + self.b)))


@lru_cache(maxsize=1)
def fitted(examples: int = EXAMPLES, seed: int = 11) -> Model:
    """Fits the trees on two thirds of the drawn examples, and calibration and thresholds on the rest."""
    rows = list(_examples(examples, seed))
    x = np.array([features(t, a, b, k) for t, a, b, k, _ in rows], dtype=float)
    y = np.array([r[-1] for r in rows], dtype=float)
    kinds = np.array([r[3] for r in rows])
    fit = np.arange(len(rows)) % 3 != 0
    trees, margin = [], np.zeros(int(fit.sum()))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_tree(x[fit], y[fit] - p, p * (1 - p), DEPTH))
        _walk(trees[-1], x[fit], margin, np.arange(len(margin)))
    held = _margin(trees, x[~fit])
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt: logistic regression on the margin, by Newton steps
        p = 1 / (1 + np.exp(-(a * held + b)))
        g = np.array([((y[~fit] - p) * held).sum() - 1e-3 * a, (y[~fit] - p).sum()])
        w = p * (1 - p)
        h = np.array([[(w * held * held).sum() + 1e-3, (w * held).sum()], [(w * held).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    model = Model(trees, float(a), float(b), {})
    p = model.probabilities(x[~fit])
    for kind in ADDED:
        mine = kinds[~fit] == kind
        model.thresholds[kind] = 2.0
        for cut in np.linspace(0.98, 0.3, 35):
            chosen = mine & (p >= cut)
            if chosen.sum() and y[~fit][chosen].mean() >= PRECISION:
                model.thresholds[kind] = float(cut)
    return model


def select(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: base ones, and added ones that don't overlap them; by start, then kind as listed."""
    bases = [base_spans(t) for t in texts]
    found = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
    out = [list(b) for b in bases]
    if found:
        p = model.probabilities(np.array([features(texts[i], *c) for i, c in found], dtype=float))
        taken: dict[int, list[tuple[int, int]]] = {}
        # equally likely up to a hundredth: the kind with the stricter format
        strict = np.array([c[2] == "number" for _, c in found])
        for j in np.lexsort((strict, -np.round(p, 2))):
            i, (a, b, kind) = found[j]
            if p[j] < model.thresholds[kind]:
                continue
            held = taken.setdefault(i, [s[:2] for s in bases[i]])
            if all(b <= s or a >= e for s, e in held):
                held.append((a, b))
                out[i].append((a, b, kind))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) of every row, in code points of the whole text.

    Null texts are empty and have no spans; null ids and repeated rows are kept; an empty table gives an empty one.
    """
    model = fitted()
    short_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            spans = select([t or "" for t in pdf["text"]], model)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans]})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns are kept."""
    model = fitted()
    short_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, select([t or "" for t in texts], model), strict=True):
            if t is not None and spans:
                parts, at = [], 0
                for a, b, kind in spans:
                    if a >= at:
                        parts += [t[at:a], f"<{kind}>"]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out)

    return docs.withColumn(text_column, cut(F.col(text_column).cast("string")))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


__all__ = ["base_spans", "candidates", "find", "fitted", "op10_pii", "redact", "select"]
