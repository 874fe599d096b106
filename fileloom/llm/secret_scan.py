"""Secret scans: patterns propose candidates, a random forest trained on labelled findings removes false positives.

A candidate's features are its length and make-up, how its characters follow each other (log odds of secrets against
other findings), how much of it dictionary words cover, words of its path and the words next to it. The forest is
grown in numpy on the driver from at most ``MAX_TRAIN`` findings and scores whole texts in Arrow batches.

No table holds labelled findings, so the query trains on ``labelled_findings``: made by rule from a seed, with secrets
of common shapes and what is mistaken for them (digests, commits, identifiers, placeholders, paths, long words).
``train`` takes any findings of the same form.

Edge cases: a null text counts as empty and a null path as ''; an empty text has no findings; repeated rows each give
their findings; an empty table gives an empty result; extra columns are not looked at. Findings of a document do not
overlap: of two candidates the one that begins first counts, then the longer.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Findings that training uses at most; those beyond it, in order of a digest of their value, are left out.
MAX_TRAIN = 4000
TREES, DEPTH, LEAST_LEAF, BINS = 40, 10, 2, 32
THRESHOLD = 0.5
#: Code points before and after a candidate whose words count as neighbours.
NEAR_BEFORE, NEAR_AFTER = 48, 24

FOUND = "doc_id long, start long, end long, kind string, score double, value_sha256 string"

#: kind, what a text must hold to be searched for it, pattern; the last group is the value. Each search is linear in the text.
KNOWN = (
    ("aws_key", ("AKIA", "ASIA"), r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})"),
    ("gitlab_token", ("glpat-",), r"(?<![A-Za-z0-9])(glpat-[A-Za-z0-9_-]{20,})"),
    ("npm_token", ("npm_",), r"(?<![A-Za-z0-9])(npm_[A-Za-z0-9]{36,})"),
    ("slack_token", ("xox",), r"(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("stripe_key", ("sk_live_", "sk_test_", "rk_live_", "rk_test_"), r"(?<![A-Za-z0-9])([sr]k_(?:live|test)_[A-Za-z0-9]{16,})"),
    ("google_key", ("AIza",), r"(?<![A-Za-z0-9])(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"),
    ("sendgrid_key", ("SG.",), r"(?<![A-Za-z0-9_.-])(SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64})"),
    ("jwt", ("eyJ",), r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("private_key", ("PRIVATE KEY-----",), r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END)"),
    ("url_password", ("://",), r"://[^\s/:@\"'<>]{1,64}:([^\s/:@\"'<>]{6,128})@"),
)
_KNOWN = tuple((k, hints, re.compile(p)) for k, hints, p in KNOWN)
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:api_?key|access_?key|key|token|secret|passw(?:or)?d|pwd|auth|credentials?)[\"']?\x20{0,3}[:=]\x20{0,3}([\"']?)([^\s\"'<>]{8,})")
_GENERIC = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_WORD = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"[0-9].*[0-9]", re.S)

SECRET_WORDS = frozenset("token secret password passwd pwd key apikey auth bearer credential credentials private access login".split())
DIGEST_WORDS = frozenset("sha sha1 sha256 md5 digest checksum hash commit revision etag integrity uuid guid id trace build version".split())
DUMMY_WORDS = frozenset("example dummy sample fake your placeholder test changeme todo redacted xxx insert".split())
TEST_PATH = frozenset("test tests fixture fixtures example examples sample samples mock mocks docs doc".split())
CONFIG_PATH = frozenset("env config conf cfg ini yaml yml properties settings credentials secrets tfvars".split())
LOCK_PATH = frozenset("lock lockfile min map dist vendor node modules svg ipynb".split())

#: What a value that stands for another one begins or ends with.
BRACKETS = frozenset("${}%<>()[]")

_CLASS = {c: 0 for c in string.digits} | {c: 1 for c in string.ascii_lowercase} | {c: 2 for c in string.ascii_uppercase}
_ALPHABET = string.digits + string.ascii_lowercase + string.ascii_uppercase + "+/_-=."
_INDEX = {c: i for i, c in enumerate(_ALPHABET)}
_SIZE = len(_ALPHABET) + 1


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret, not overlapping."""
    found = []
    for kind, hints, p in _KNOWN:
        if any(h in text for h in hints):
            found += [(*m.span(1), kind) for m in p.finditer(text)]
    found += [(*m.span(2), "assigned") for m in _ASSIGNED.finditer(text)]
    found += [(*m.span(), "generic") for m in _GENERIC.finditer(text) if _DIGIT.search(m.group())]
    out, at = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out.append((s, e, kind))
            at = e
    return out


def _transitions(value: str) -> np.ndarray:
    i = np.fromiter((_INDEX.get(c, _SIZE - 1) for c in value), np.int64, len(value))
    return i[:-1] * _SIZE + i[1:]


def coverage(value: str, dictionary: frozenset, longest: int = 12) -> float:
    """Share of the characters that dictionary words of three letters or more cover, longest first from the left."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low) - 2:
        for n in range(min(longest, len(low) - i), 2, -1):
            if low[i : i + n] in dictionary:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(len(value), 1)


def _split(s: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Za-z]+[0-9]*|[A-Za-z]+", s)}


def features(value: str, kind: str, before: str, after: str, path: str, model: dict) -> list[float]:
    n = max(len(value), 1)
    counts = Counter(value)
    classes = [_CLASS.get(c, 3) for c in value]
    share = [classes.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    longest_word = max((len(m) for m in _WORD.findall(value)), default=0)
    run = longest = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    steps = _transitions(value)
    odds = float(model["odds"][steps].mean()) if len(steps) else 0.0
    near = _split(before) | _split(after)
    parts = _split(path)
    return [
        len(value), entropy, *share, changes, odds, coverage(value, model["dictionary"]), longest_word / n, len(counts) / n, longest,
        float(all(c in string.hexdigits for c in value)), float(kind not in ("assigned", "generic")), float(kind == "assigned"),
        float(before[-1:] in "\"'" and before[-1:] != ""), len(near & SECRET_WORDS), len(near & DIGEST_WORDS), len((near | _split(value)) & DUMMY_WORDS),
        len(parts & TEST_PATH), len(parts & CONFIG_PATH), len(parts & LOCK_PATH), float(value[:1] in BRACKETS) + float(value[-1:] in BRACKETS),
    ]


# --- random forest -----------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7, trees: int = TREES, depth: int = DEPTH) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature or -1, threshold, left, right, share of secrets), each on a bootstrap sample."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    some = max(1, round(math.sqrt(x.shape[1])) + 1)
    forest = []
    for _ in range(trees):
        sample = rng.integers(0, len(x), len(x))
        feature, threshold, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            k = len(feature)
            p = y[rows].mean()
            for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, p)):
                a.append(v)
            if level == depth or p in (0.0, 1.0) or len(rows) < 2 * LEAST_LEAF:
                return k
            best = (p * (1 - p) * len(rows) - 1e-9, -1, -1)
            for f in rng.choice(x.shape[1], some, replace=False):
                m = len(cuts[f]) + 1
                n = np.cumsum(np.bincount(binned[rows, f], minlength=m))[:-1]
                s = np.cumsum(np.bincount(binned[rows, f], y[rows], minlength=m))[:-1]
                ok = (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
                if not ok.any():
                    continue
                n, s = n[ok], s[ok]
                rest, more = len(rows) - n, y[rows].sum() - s
                impurity = s * (1 - s / n) + more * (1 - more / rest)
                b = int(np.argmin(impurity))
                best = min(best, (float(impurity[b]), int(f), int(np.flatnonzero(ok)[b])))
            if best[1] < 0:
                return k
            _, f, b = best
            goes = binned[rows, f] <= b
            feature[k], threshold[k] = f, float(cuts[f][b])
            left[k] = node(rows[goes], level + 1)
            right[k] = node(rows[~goes], level + 1)
            return k

        node(sample, 0)
        forest.append((np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)))
    return forest


def vote(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Mean share of secrets in the leaves that each row falls into."""
    out = np.zeros(len(x))
    for feature, threshold, left, right, value in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            k = at[rows]
            goes = x[rows, feature[k]] <= threshold[k]
            at[rows] = np.where(goes, left[k], right[k])
        out += value[at]
    return out / max(len(forest), 1)


def train(findings: list[tuple[str, str, str, str, int]], max_train: int = MAX_TRAIN) -> dict:
    """findings: (text before, value, text after, path, 1 for a secret or 0). One class alone decides without a forest."""
    own = sorted(findings, key=lambda f: hashlib.md5(repr(f).encode()).hexdigest())[:max_train]
    seen = np.ones((2, _SIZE * _SIZE))
    words: Counter = Counter()
    for before, value, after, _, label in own:
        np.add.at(seen[label], _transitions(value), 1)
        words.update({w.lower() for w in _WORD.findall(f"{before} {after}") if len(w) > 2} | ({w.lower() for w in _WORD.findall(value) if len(w) > 2} if not label else set()))
    odds = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    model = {"odds": odds, "dictionary": frozenset(w for w, c in words.items() if c > 1), "forest": [], "prior": 1.0}
    y = np.array([f[4] for f in own], float)
    if 0 < y.sum() < len(y):
        x = np.array([features(v, _kind(b, v, a), b, a, p, model) for b, v, a, p, _ in own])
        model["forest"] = grow(x, y)
    elif len(y):
        model["prior"] = float(y.mean())
    return model


def _kind(before: str, value: str, after: str) -> str:
    whole, s = f"{before}{value}{after}", len(before)
    return next((k for a, b, k in candidates(whole) if a <= s < b), "generic")


def scan_text(text: str, path: str, model: dict) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the candidates that the forest does not remove."""
    found = candidates(text)
    if not found:
        return []
    if model["forest"]:
        x = np.array([features(text[s:e], k, text[max(0, s - NEAR_BEFORE) : s], text[e : e + NEAR_AFTER], path, model) for s, e, k in found])
        scores = vote(model["forest"], x)
    else:
        scores = np.full(len(found), model["prior"])
    return [(*c, round(float(p), 6)) for c, p in zip(found, scores, strict=True) if p >= THRESHOLD]


def scan(docs: DataFrame, model: dict, path: str = "source") -> DataFrame:
    """doc_id, start, end, kind, score and the value's SHA-256 of each finding; path names the column with paths."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                for s, e, k, p in scan_text(text, own.as_py() or "", shared.value):
                    rows.append((i, s, e, k, p, hashlib.sha256(text[s:e].encode("utf-8", "replace")).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", "text", path).mapInArrow(run, FOUND)


# --- labelled findings by rule -----------------------------------------------------------------------------------


def labelled_findings(n: int = 3000, seed: int = 20) -> list[tuple[str, str, str, str, int]]:
    """n findings, about half of them secrets; the same for the same n and seed."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    hexes, base62 = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "an be con de er for ge heit in ion ka la men nen or pre que ra st tion un ver wo ya zu".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 5)))

    def secret() -> str:
        return rng.choice(
            [
                lambda: pick(hexes, rng.choice([32, 40, 48, 64])), lambda: pick(base62, rng.randint(20, 48)), lambda: pick(base62 + "+/", rng.choice([40, 43])),
                lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(base62, 36),
                lambda: f"xoxb-{pick(string.digits, 11)}-{pick(base62, 24)}", lambda: f"eyJ{pick(base62, 20)}.{pick(base62, 40)}.{pick(base62 + '-_', 43)}",
                lambda: pick(base62 + "!%&*", rng.randint(12, 20)), lambda: f"{rng.choice(['sk', 'rk'])}_live_{pick(base62, rng.randint(24, 40))}",
                lambda: "AIza" + pick(base62 + "-_", 35), lambda: "glpat-" + pick(base62 + "-_", 20), lambda: "npm_" + pick(base62, 36),
                lambda: f"SG.{pick(base62 + '-_', 22)}.{pick(base62 + '-_', 43)}", lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
                lambda: pick(base62 + "+/", 86) + "==",
            ]
        )()

    def other() -> tuple[str, str, str]:
        return rng.choice(
            [
                lambda: (f"{rng.choice(['sha256:', 'commit ', 'md5 = ', 'integrity: ', 'etag: '])}", pick(hexes, rng.choice([32, 40, 64])), " "),
                lambda: ("id: ", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), " "),
                lambda: (f"{prose()} ", pick(string.digits, rng.randint(20, 26)), f" {prose()}"),
                lambda: (f"{rng.choice(['token', 'api_key', 'password'])} = \"", rng.choice(["your-token-here-123", "xxxxxxxxxxxxxxxxxxxx00", "changeme-changeme-01", "example-key-0000-1111", "INSERT_YOUR_KEY_HERE"]), "\""),
                lambda: (f"{rng.choice(['token', 'secret', 'auth', 'key'])}: ", word() + word() + word() + word(), f" {prose()}"),
                lambda: ("see ", "/".join(word() for _ in range(6)) + f"/v{rng.randint(10, 99)}", ""),
                lambda: ("", "_".join(word() for _ in range(5)) + str(rng.randint(10, 99)), "("),
                lambda: (f"{prose()} ", "".join(word() for _ in range(7)) + f"{rng.randint(10, 99)}", f" {prose()}"),
                lambda: ("data:image/png;base64,", "iVBORw0KGgo" + pick(base62 + "+/", 60), "==\""),
                lambda: ("-" * 3, "=-" * 12 + "0-0", ""),
                lambda: (f"{prose()} http://", f"{word()}/{word()}/{rng.randint(1000, 2030)}/{rng.randint(1, 12)}/{word()}-{word()}-{word()}", f" {prose()}"),
                lambda: (f"{rng.choice(['ISBN', 'order', 'invoice', 'SKU'])} ", "-".join(pick(string.digits, k) for k in (3, 1, 6, 5, 4, 1)), f" {prose()}"),
                lambda: ("src=\"", f"static/{word()}.{pick(hexes, 20)}.chunk.js", "\""),
                lambda: (f"{word()} ", "".join(word().title() for _ in range(6)) + f"V{rng.randint(10, 99)}", "()"),
                lambda: (f"{rng.choice(['token', 'secret', 'password', 'key'])} = ", f"{rng.choice(['os.environ', 'getenv', 'config', 'settings', 'process.env'])}.{word()}_{word()}", f" {prose()}"),
                lambda: (f"{rng.choice(['token', 'secret', 'password', 'key'])}: ", (rng.choice(['${', '{{', '%(', '<']) + "_".join(word() for _ in range(rng.randint(1, 5))) + rng.choice(['}', '}}', ')s', '>'])).upper(), f" {prose()}"),
                lambda: (f"{prose()} mysql://", f"{rng.choice(['user', 'root'])}:{rng.choice(['password', 'example', 'changeme', 'yourpass'])}", "@localhost/db"),
                lambda: (f"{prose()} ", f"20{pick(string.digits, 2)}-{pick(string.digits, 2)}-{pick(string.digits, 2)}T{pick(string.digits, 6)}-{word()}-{word()}", f" {prose()}"),
                lambda: (f"{rng.choice(['token', 'secret', 'password', 'key'])}: ", rng.choice("-=*#.x_") * rng.randint(8, 60), f" {prose()}"),
                lambda: ("uuid=", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), f" {prose()}"),
            ]
        )()

    paths = ["src0", "src/app.py", "config/settings.yaml", ".env", "deploy/prod.tfvars", "web/index.html", "README.md", ""]
    weak = ["tests/fixtures/data.json", "docs/example.md", "yarn.lock", "dist/app.min.js", "node_modules/a/b.js", *paths]
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            name = rng.choice(["token", "api_key", "secret", "password", "auth_token", "access_key", "private key", "Authorization: Bearer"])
            joint, quote = rng.choice([" = ", "=", ": ", " "]), rng.choice(["\"", "\"", "'", ""])
            out.append((f"{rng.choice(['', prose() + ' '])}{name}{joint}{quote}", secret(), f"{quote} {prose()}", rng.choice(paths), 1))
        else:
            before, value, after = other()
            out.append((f"{rng.choice(['', prose() + ' '])}{before}", value, after, rng.choice(weak), 0))
    return out
