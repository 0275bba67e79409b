"""The name scorers for one pair at a time, for SQL functions, whose lexicon travels with them.

The same rules as in ``names``, over regular expressions of whole names. DataFrames are served better
by ``names.features`` and ``names.scored``, which parse a name once and take dictionaries of any size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fuzzy, names
from . import text as t
from .lexicon import Lexicon

_LETTERS = str.maketrans(t.ARABIC_LETTERS, t.PERSIAN_LETTERS)
_PERSIAN = str.maketrans(t.PERSIAN_DIGITS, t.DIGITS)
_ALL_DIGITS = str.maketrans(t.PERSIAN_DIGITS + t.ARABIC_DIGITS, 2 * t.DIGITS)


def python_pattern(java: str) -> re.Pattern:
    """A pattern of ``text`` or ``names``, whose classes Python spells otherwise."""
    return re.compile(re.sub(r"\(\?iu?U?\)|\(\?U\)", lambda m: "(?i)" if "i" in m[0] else "", java).replace(r"[\p{L}\p{N}_]", r"\w").replace(r"[\s\p{Z}]", r"\s").replace(r"\p{Nd}", r"\d"))


def base_clean(name: str | None) -> str:
    return (name or "").translate(_LETTERS).replace(t.ZWNJ, " ").translate(_PERSIAN).lower()


def slot_clean(name: str) -> str:
    return re.sub(f"{t.TATWEEL}|{t.DIACRITICS}", "", re.sub(t.ALEFS, "ا", name)).translate(_LETTERS).translate(_ALL_DIGITS).upper()


class Phrases:
    """Phrases, as runs of pieces, and what stands for them."""

    def __init__(self, entries: dict[str, str], cut: Callable[[str], list[str]], most: int | None = None):
        self.ids = {tuple(cut(k)): v for k, v in entries.items() if cut(k) and (most is None or len(cut(k)) <= most)}
        self.sizes = sorted({len(k) for k in self.ids}, reverse=True)

    def resolve(self, pieces: list[str], free=lambda pieces, a, b: True) -> list[tuple[str, bool]]:
        """(word, hit): the longest phrase from each place on, from left to right."""
        out: list[tuple[str, bool]] = []
        at = 0
        while at < len(pieces):
            size = next((n for n in self.sizes if tuple(pieces[at : at + n]) in self.ids and free(pieces, at, at + n)), 0)
            out.append((self.ids[tuple(pieces[at : at + size])], True) if size else (pieces[at], False))
            at += size or 1
        return out


_SEGMENT = re.compile(r"\w+|\W", re.S)
_WORD = re.compile(r"\w")
_LINE_CODE = re.compile(f"(?<= ){names.CODE_WORDS}(?= )".replace(r"\p{Nd}", r"\d"))
_SPELLINGS = [(python_pattern(p), put.replace("$", "\\")) for p, put in names.SPELLINGS]
_ML, _G, _VOLUME = python_pattern(t.TRIE_ML), python_pattern(t.TRIE_G), python_pattern(t.SLOT_VOLUME)
_FINDS = {x: python_pattern(getattr(names, x)) for x in ("ENTITY_BRAND", "ENTITY_TYPE", "VOLUME", "MIXED_CODE", "LONE_CODE", "NAMED_CODE", "LATIN")}
_KINDS = {"measures": re.compile(r"(?i)\d+(?:ml|g)"), "codes": re.compile(r"(?i)[a-z]+\d+|\d+[a-z]+|\d+"), "latin": re.compile("(?i)[a-z]{3,}"), "farsi": re.compile(t.FARSI)}
_UNITS = {"لیتر": "L", "L": "L", "میلیگرم": "MG", "MG": "MG", "گرم": "G", "G": "G", "OZ": "OZ"}


def _beside_nothing(pieces: list[str], a: int, b: int) -> bool:
    return not (a and _WORD.match(pieces[a - 1])) and not (b < len(pieces) and _WORD.match(pieces[b]))


class Scorer:
    """Parsers and scorers with one lexicon."""

    def __init__(self, lexicon: Lexicon):
        brands = dict(lexicon.brands)
        kinds = {k.lower(): f"type_{k.replace(' ', '_')}".lower() for k in lexicon.types}
        self.both = Phrases({k.lower(): v.lower() for k, v in lexicon.brands} | kinds, str.split)
        self.short = Phrases(brands, lambda x: x.split(" "), 2)
        self.passes = [Phrases(x, _SEGMENT.findall) for x in ({base_clean(k): v for k, v in lexicon.brands}, {base_clean(k): "TYPE_" + k.replace(" ", "_").upper() for k in lexicon.types})]
        self.types, self.stops = frozenset(lexicon.types), frozenset(lexicon.stops)
        self.low_stops, self.clean_stops = {x.lower() for x in lexicon.stops}, {base_clean(x) for x in lexicon.stops}
        self.trie, self.slots, self.regex = (lru_cache(1 << 15)(f) for f in (self._trie, self._slots, self._regex))

    def _trie(self, name: str) -> dict:
        spaced = _G.sub(r" \1g ", _ML.sub(r" \1ml ", base_clean(name)))
        words = [w for w, _ in self.both.resolve(spaced.split()) if w not in self.low_stops]
        found = {k: {w for w in words if p.fullmatch(w)} for k, p in _KINDS.items()}
        found["codes"] -= found["measures"]
        return found | {"tokens": words, "brands": {w for w in words if w.startswith("brand_")}, "types": {w for w in words if w.startswith("type_")}}

    def _slots(self, name: str) -> dict:
        clean, volume = slot_clean(name), None
        if hit := _VOLUME.search(clean):
            volume = f"VOL:{hit[1]}{_UNITS.get(re.sub(f'[ {t.ZWNJ}]', '', hit[2]).upper(), 'ML')}"
            clean = f"{clean[: hit.start()]} {clean[hit.end() :]}"
        words = self.short.resolve([w for w in clean.split() if w not in self.stops])
        line = f" {' '.join(w for w, _ in words)} "
        code = _LINE_CODE.search(line)
        shown = code[0] if code else ""
        for spelt, letters in names.SPELT_CODES:
            shown = re.sub(f"^{spelt} ", letters, shown)
        rest = [w for w in _LINE_CODE.sub("", line).split() if not w.startswith("BRAND_")]
        return {"brand": next((w for w, hit in words if hit), None), "type": {w for w in rest if w in self.types}, "model": [w for w in rest if w not in self.types], "code": "CODE:" + shown.replace(" ", "") if code else None, "volume": volume}

    def _regex(self, name: str) -> dict:
        line = base_clean(name)
        for phrases in self.passes:
            line = "".join(w for w, _ in phrases.resolve(_SEGMENT.findall(line), _beside_nothing))
        for pattern, put in _SPELLINGS:
            line = pattern.sub(put, line)
        whole = " ".join(w for w in line.split() if w not in self.clean_stops)
        rest, found = whole, {"text": whole}
        for key, name in (("brands", "ENTITY_BRAND"), ("types", "ENTITY_TYPE"), ("volumes", "VOLUME")):
            found[key] = set(_FINDS[name].findall(whole))
            rest = _FINDS[name].sub(" ", rest)
        return found | {"latin": set(_FINDS["LATIN"].findall(rest)), "codes": {x for p in ("MIXED_CODE", "LONE_CODE", "NAMED_CODE") for x in _FINDS[p].findall(rest)}}

    def trie_score(self, site: str | None, target: str | None) -> float:
        if not site or not target:
            return 0.0
        s, e = self.trie(site), self.trie(target)
        if s["tokens"] == e["tokens"]:
            return 1.0
        text = " ".join(s["tokens"])
        lost = lambda kind, least: any(w not in text and (len(w) < names.NEAR_LENGTH or not _near(w, text, least)) for w in e[kind])
        apart = any(e[k] and not s[k] & e[k] and (s[k] or k != "types") for k in ("brands", "types", "measures", "codes"))
        if apart or lost("latin", names.LATIN_LEAST) or lost("farsi", names.FARSI_LEAST):
            return 0.0
        return round(_residual(text, " ".join(e["tokens"])), 4)

    def regex_score(self, site: str | None, target: str | None) -> float:
        s, e = self.regex(site or ""), self.regex(target or "")
        apart = any(s[k] and e[k] and not s[k] & e[k] for k in ("brands", "types", "volumes", "latin"))
        return 0.0 if apart or (s["codes"] | e["codes"] and not s["codes"] & e["codes"]) else _residual(s["text"], e["text"])

    def slot_score(self, site: str | None, target: str | None) -> float:
        if not (site or "").strip() or not (target or "").strip():
            return 0.0
        s, e = self.slots(site), self.slots(target)
        alike = lambda key, site_only, target_only: 1.0 if s[key] == e[key] else target_only if s[key] is None else site_only if e[key] is None else 0.0
        union = s["type"] | e["type"]
        brand, kind, code, volume = alike("brand", 0.5, 0.5), len(s["type"] & e["type"]) / len(union) if union else 1.0, alike("code", 0.8, 0.3), alike("volume", 0.7, 0.7)
        parts = (brand, kind, _coverage(s["model"], e["model"]), code, volume)
        caps = [cap for clash, cap in ((not code, names.CODE_CAP), (not volume, names.VOLUME_CAP), (not brand, names.BRAND_CAP), (kind < names.TYPE_LEAST, names.TYPE_CAP)) if clash]
        return round(min([sum(w * x for w, x in zip(names.WEIGHTS, parts, strict=True)), *caps]), 4)


def _near(word: str, text: str, least: int) -> bool:
    """Whether a stretch of the text as long as the word has that ratio; its letters in common bound the ratio."""
    size, letters = len(word), Counter(word)
    stretches = {text[k : k + size] for k in range(max(1, len(text) - size + 1))}
    common = {x: (letters & Counter(x)).total() for x in stretches}
    return any(fuzzy.ratio(word, x) >= least for x, n in common.items() if 200 * n >= (least - 0.5) * (size + len(x)))


def _residual(a: str, b: str) -> float:
    return (fuzzy.token_set_ratio(a, b) * 0.4 + fuzzy.token_sort_ratio(a, b) * 0.6) / 100.0


def _coverage(site: list[str], target: list[str]) -> float:
    if not target:
        return 0.0 if site else 1.0
    common = Counter(site) & Counter(target)

    def beyond(words: list[str]) -> list[str]:
        spare = common.copy()
        return [w for w in words if not spare[w] or spare.subtract([w])]

    unmet, left = beyond(target), beyond(site)
    hits = len(target) - len(unmet)
    for word in unmet:
        best = max(((1 - fuzzy.edit_distance(word, x) / max(len(word), len(x)), -k) for k, x in enumerate(left)), default=(0.0, 0))
        if best[0] >= 0.80:
            del left[-best[1]]
            hits += 1
    return min(1.0, hits / len(target)) * min(1.0, len(site) / len(target))


SLOTS = "brand string, type array<string>, model array<string>, code string, volume string"


def register(spark: SparkSession, lexicon: Lexicon) -> None:
    """similarity_trie, similarity_regex, similarity_slot, normalize_trie, normalize_regex, parse_product,
    token_set_ratio and token_sort_ratio for SQL; the lexicon's size is checked by ``load_lexicon``."""
    made: list[Scorer] = []

    def scorer() -> Scorer:
        if not made:
            made.append(Scorer(lexicon))
        return made[0]

    def pairwise(rate):
        return lambda a, b: pd.Series([rate(x, y) for x, y in zip(a.where(a.notna(), None), b.where(b.notna(), None), strict=True)])

    for kind in ("trie", "regex", "slot"):
        spark.udf.register(f"similarity_{kind}", F.pandas_udf(pairwise(lambda x, y, kind=kind: getattr(scorer(), f"{kind}_score")(x, y)), "double"))
    for name, rate in (("token_set_ratio", fuzzy.token_set_ratio), ("token_sort_ratio", fuzzy.token_sort_ratio)):
        spark.udf.register(name, F.pandas_udf(pairwise(lambda x, y, rate=rate: rate(x or "", y or "")), "int"))

    def parse(found: pd.Series) -> pd.DataFrame:
        slots = [scorer().slots(x) if isinstance(x, str) and x.strip() else {"brand": None, "type": set(), "model": [], "code": None, "volume": None} for x in found]
        return pd.DataFrame({k: [sorted(x[k]) if k == "type" else x[k] for x in slots] for k in ("brand", "type", "model", "code", "volume")})

    spark.udf.register("parse_product", F.pandas_udf(parse, SLOTS))
    texts = {"trie": lambda x: " ".join(scorer().trie(x)["tokens"]), "regex": lambda x: scorer().regex(x)["text"]}
    for kind, shown in texts.items():
        spark.udf.register(f"normalize_{kind}", F.pandas_udf(lambda column, shown=shown: pd.Series([shown(x) if isinstance(x, str) else "" for x in column]), "string"))
