"""Message templates and display rewriting.

pairs (pair_id, source, target) give rules (rule_id, pattern, parts, specificity, anchor), built from columns: a table of a source's
placeholders with the slot that each fills, its literals between them, and the same of the target. A display text is rewritten by one
pass of a Rewriter, which holds the rules (counted to fit, see Rewriter) in every task; texts stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PRINTF, strip, two_characters
from .catalog import Rejected
from .display_forms import FORMS

PLACEHOLDER = r"\{[^{}\n]+\}|" + PRINTF
TAG = r"\[[^\]]*\]"
#: What stands for a number, for text at the start of a line, and for other text in a rule.
NUMBER = r"( *[-+0-9.,eExXa-fA-F]+ *)"
STYLE = r"\[/?(?:color|bgcolor|font_size|b|i|u)(?:=[^\]\n]+)?\]"
LEADING = rf"((?:{STYLE}|[^\n：:・\[\]])*?)"
ANYTHING = r"([^\n]*?)"


def visible_parts(source: Column) -> Column:
    """The stretches of text outside tags and placeholders."""
    return F.flatten(F.transform(F.split(source, TAG, -1), lambda s: F.split(s, PLACEHOLDER, -1)))


def bigrams(source: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(visible_parts(source), two_characters)))


def bigram_frequency(pairs: DataFrame) -> DataFrame:
    """(gram, n): how many pairs have each two-character piece of visible text."""
    return pairs.select(F.explode(bigrams(F.col("source"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def rare_anchors(pairs: DataFrame) -> DataFrame:
    """(pair_id, anchor): of each pair's pieces the one that the fewest pairs have, the least of equals."""
    grams = pairs.select("pair_id", F.explode(bigrams(F.col("source"))).alias("gram"))
    return grams.join(bigram_frequency(pairs), "gram").groupBy("pair_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("anchor"))


def longest_part(source: Column) -> Column:
    """The longest visible part, the first of equals; empty when there is none."""
    return F.aggregate(visible_parts(source), F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def token_ordinals(text: Column) -> Column:
    """Placeholders of a text with how many equal ones stand before each."""
    found = placeholders(text)
    return F.transform(found, lambda t, i: F.struct(t.alias("token"), F.size(F.filter(F.slice(found, F.lit(1), i), lambda x: x == t)).alias("ordinal")))


def slots(text: Column) -> Column:
    """A name for what each placeholder shows: equal tokens in braces show one thing, {name} and printf tokens one each."""
    shared = lambda t: t["token"].startswith("{") & (t["token"] != "{name}")
    return F.transform(token_ordinals(text), lambda t: F.when(shared(t), t["token"]).otherwise(F.concat(t["token"], F.lit("\n"), t["ordinal"].cast("string"))))


def literals(text: Column, percents: Column) -> Column:
    """The stretches between placeholders; percents: whether a doubled percent sign stands for one."""
    return F.transform(F.split(text, PLACEHOLDER, -1), lambda p: F.when(percents, F.replace(p, F.lit("%%"), F.lit("%"))).otherwise(p))


def specificity(source: Column) -> Column:
    """Characters outside placeholders; a doubled percent sign counts once where there are placeholders."""
    return F.aggregate(literals(source, source.rlike(PLACEHOLDER)), F.lit(0), lambda n, p: n + F.length(p))


def _quoted(literal: Column) -> Column:
    return F.regexp_replace(literal, r"[\\.^$|?*+()\[\]{}]", r"\\$0")


#: Ids of the pairs of one alias begin at multiples of this.
ALIAS_STEP = 1 << 40


def with_aliases(pairs: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """pairs and, behind them, their forms under the named FORMS where these change the source."""
    if unknown := set(names) - set(FORMS):
        raise Rejected(f"unknown aliases: {sorted(unknown)}")
    out = pairs.select("pair_id", "source", "target")
    for n, name in enumerate(names, 1):
        source, target = FORMS[name].pair(F.col("source"), F.col("target"))
        more = pairs.select((F.col("pair_id") + n * ALIAS_STEP).alias("pair_id"), source.alias("alias"), target.alias("target"), "source").where("alias <> source")
        out = out.unionByName(more.select("pair_id", F.col("alias").alias("source"), "target"))
    return out


def compile_rules(pairs: DataFrame) -> DataFrame:
    """(rule_id, pattern, parts, specificity, anchor) of pairs whose target differs and whose visible text is long enough:
    one character where the source has placeholders (then the whole text must match), else three.

    A slot is a group of the pattern where it comes first, and a back-reference afterwards. A target with a placeholder that its
    source lacks gives no rule. parts are literals and group numbers.
    """
    source, target = F.col("source"), F.col("target")
    several = source.rlike(PLACEHOLDER)
    longest = strip(longest_part(source))
    fit = pairs.where((source != target) & (F.length(longest) >= F.when(several, 1).otherwise(3)))
    table = fit.select(
        "pair_id", "source", several.alias("several"), longest.alias("longest"), placeholders(source).alias("tokens"), slots(source).alias("slots"),
        literals(source, several).alias("literals"), slots(target).alias("put_slots"), literals(target, several).alias("put_literals"),
    ).withColumn("groups", F.array_distinct("slots")).where(F.size(F.array_except("put_slots", "groups")) == 0)
    group = lambda slot: F.array_position("groups", slot).cast("int")

    def piece(token: Column, i: Column) -> Column:
        slot = F.get("slots", i)
        first = F.array_position("slots", slot) == i + 1
        kind = F.when(token.rlike("^%.*[difxX]$"), NUMBER).when((i == 0) & (F.get("literals", F.lit(0)) == ""), LEADING).otherwise(ANYTHING)
        return F.when(first, kind).otherwise(F.concat(F.lit("\\"), group(slot).cast("string")))

    woven = F.zip_with(F.transform("literals", _quoted), F.transform("tokens", piece), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    open_end = F.when(F.col("several") & (F.element_at("literals", -1) == ""), r"(?=\n|\Z)").otherwise("")
    pattern = F.concat(F.concat_ws("", woven), open_end)
    whole = F.col("several") & (F.length("longest") == 1)
    text_part = lambda x: F.struct(x.alias("lit"), F.lit(None).cast("int").alias("grp"))
    slot_part = lambda s: F.struct(F.lit(None).cast("string").alias("lit"), group(s).alias("grp"))
    parts = F.flatten(F.zip_with("put_literals", "put_slots", lambda x, s: F.when(s.isNull(), F.array(text_part(x))).otherwise(F.array(text_part(x), slot_part(s)))))
    shaped = table.select(
        "pair_id", F.when(whole, F.concat(F.lit("^"), pattern, F.lit(r"\Z"))).otherwise(pattern).alias("pattern"), parts.alias("parts"),
        F.aggregate("literals", F.lit(0), lambda n, p: n + F.length(p)).alias("specificity"), "longest",
    )
    anchored = shaped.join(rare_anchors(pairs), "pair_id", "left")
    return anchored.select(F.col("pair_id").alias("rule_id"), "pattern", "parts", "specificity", F.coalesce("anchor", F.substring("longest", 1, 2)).alias("anchor"))


#: Hidden spans, pieces between them, what joins the entries of a list, and the source's script.
HIDDEN = re.compile(r"\[img(?:=[^\]]*)?\][\s\S]*?\[/img\]|\[[^\]\n]*\]")
PIECE = re.compile(r"[^\[\]\n（）()　：]+")
JOINT = re.compile(r"([・／ ])")
SCRIPT = re.compile("[ぁ-ヺ㐀-鿿]")
SYLLABLE = re.compile("[ぁ-ヺ]")
MOST_DEPTH = 6
EXACT_WEIGHT = 1_000_000


@dataclass
class Rewriter:
    """Rewrites display texts; __call__ gives the new text, or None where nothing changes.

    In this order: the exact entry; a known prefix before an exact entry; a word written downwards, a character a line. Else rules and exact
    pieces between tags are woven in, captured text rewritten in turn; where known source text is left, piece by piece and then
    line by line, each kept only when it leaves less. Answers of the first levels are remembered, up to MOST_KNOWN.
    """

    exact: dict[str, str]
    rules: dict[int, tuple[str, list, int, str]]
    prefixes: tuple[str, ...] = ()
    known: dict[str, str] = field(default_factory=dict)
    MOST_KNOWN = 8192

    def __post_init__(self) -> None:
        self.by_anchor: dict[str, list[int]] = {}
        for n, (*_, anchor) in self.rules.items():
            self.by_anchor.setdefault(anchor, []).append(n)
        self.compiled: dict[int, re.Pattern] = {}

    def __call__(self, text: str) -> str | None:
        return self.rewritten(text, 0) or None

    def rewritten(self, text: str, depth: int) -> str:
        if depth >= MOST_DEPTH:
            return ""
        settled = self.settled(text)
        if settled is None and (settled := self.known.get(text)) is None:
            settled = self.improved(text, self.woven(text, depth), depth)
            settled = "" if settled == text else settled
            if depth <= 2:
                if len(self.known) >= self.MOST_KNOWN:
                    self.known.clear()
                self.known[text] = settled
        return settled

    def settled(self, text: str) -> str | None:
        """The answer that needs no rule; None if there is none."""
        if text in self.exact:
            return self.exact[text]
        for prefix in self.prefixes:
            if text.startswith(prefix) and (body := text[len(prefix) :]) in self.exact:
                return prefix + self.exact[body]
        lines = text.split("\n")
        if len(lines) > 2 and all(len(line) == 1 for line in lines):
            return "\n".join(self.exact.get("".join(lines), ""))
        return None

    def tried(self, text: str) -> Iterator[int]:
        """Rules whose anchor the text has."""
        if len(self.by_anchor) < len(text):
            held = [a for a in self.by_anchor if a in text]
        else:
            held = [a for a in {text[i : i + k] for k in (1, 2) for i in range(len(text))} if a in self.by_anchor]
        for anchor in held:
            yield from self.by_anchor[anchor]

    def woven(self, text: str, depth: int) -> str:
        hidden = [m.span() for m in HIDDEN.finditer(text)]
        found: list[tuple] = []
        for m in PIECE.finditer(text):
            put = self.exact.get(m[0], m[0])
            if put != m[0] and not any(m.start() < b and a < m.end() for a, b in hidden):
                found.append((m.start(), -m.end(), -EXACT_WEIGHT, 0, -1, put))
        for n in self.tried(text):
            pattern, _, weight, _ = self.rules[n]
            if n not in self.compiled:
                self.compiled[n] = re.compile(pattern)
            for m in self.compiled[n].finditer(text):
                if m.end() > m.start() and not any(a < x < b for a, b in hidden for x in m.span()):
                    found.append((m.start(), -m.end(), -weight, m.re.groups, n, m))
        out, at = [], 0
        for start, end, _, _, n, put in sorted(found, key=lambda f: f[:5]):
            if start >= at:
                out += [text[at:start], put if n < 0 else self.filled(put, n, hidden, depth)]
                at = -end
        return "".join(out) + text[at:]

    def filled(self, m: re.Match, n: int, hidden: list[tuple[int, int]], depth: int) -> str:
        """The target of a rule, with what the match captured rewritten unless it lies in a tag."""
        out = []
        for part in self.rules[n][1]:
            if part["grp"] is None:
                out.append(part["lit"])
                continue
            start, end = m.span(part["grp"])
            free = end - start < len(m.string) and not any(a <= start and end <= b for a, b in hidden)
            value = m[part["grp"]] or ""
            out.append(free and self.rewritten(value, depth + 1) or value)
        return "".join(out)

    def left(self, text: str) -> int:
        """How many pieces still look like the source."""
        if not SCRIPT.search(text):
            return 0
        pieces = (p for m in PIECE.finditer(HIDDEN.sub("\n", text)) for p in JOINT.split(m[0])[::2])
        return sum(bool(SYLLABLE.search(p)) or self.exact.get(p, p) != p for p in pieces)

    def improved(self, text: str, out: str, depth: int) -> str:
        if not (rest := self.left(out)):
            return out
        if (other := self.by_pieces(text, depth)) and self.left(other) < rest:
            out, rest = other, self.left(other)
        lines, new = text.split("\n"), out.split("\n")
        if rest and 1 < len(lines) == len(new) and depth + 1 < MOST_DEPTH:
            for i, line in enumerate(lines):
                if (bad := self.left(new[i])) and (one := self.rewritten(line, depth + 1)) and self.left(one) < bad:
                    new[i] = one
            out = "\n".join(new)
        return out

    def by_pieces(self, text: str, depth: int) -> str:
        """All visible pieces in the source's script one by one; empty if one of them cannot be had."""
        hidden = [m.span() for m in HIDDEN.finditer(text)]
        pieces = list(PIECE.finditer(text))
        if len(pieces) == 1 and pieces[0][0] == text:
            return self.listed(text, depth, True) or ""
        out, at = [], 0
        for m in pieces:
            if SCRIPT.search(m[0]) and not any(m.start() < b and a < m.end() for a, b in hidden):
                # beside a tag a piece is part of a styled sentence: exact entries only
                loose = text[m.start() - 1 : m.start()] != "]" and text[m.end() : m.end() + 1] != "["
                put = self.exact.get(m[0]) or self.listed(m[0], depth, loose) or (loose and self.clean(m[0], depth))
                if not put:
                    return ""
                out += [text[at : m.start()], put]
                at = m.end()
        new = "".join(out) + text[at:]
        return "" if new == text else new

    def clean(self, text: str, depth: int) -> str:
        """The rewritten text, if no syllable of the source is in it."""
        new = self.rewritten(text, depth + 1)
        return "" if SYLLABLE.search(new) else new

    def listed(self, body: str, depth: int, loose: bool) -> str | None:
        """A list entry by entry, the longest known run of entries first; None if one of them cannot be had."""
        cells = JOINT.split(body)
        if len(cells) == 1:
            return None
        out, i = [], 0
        while i < len(cells):
            runs = (j for j in range(len(cells) - 1, i - 1, -2) if "".join(cells[i : j + 1]) in self.exact)
            last = next(runs, i)
            entry = "".join(cells[i : last + 1])
            put = self.exact.get(entry)
            if put is None and not SCRIPT.search(entry):
                put = entry
            if put is None and loose:
                put = self.clean(entry, depth) or None
            if put is None:
                return None
            out += [put, *cells[last + 1 : last + 2]]
            i = last + 2
        return "".join(out)


#: Rules and exact entries that every task may hold: how many, and their characters.
MOST_PAIRS = 200_000
MOST_CHARACTERS = 64_000_000


def rewriter(pairs: DataFrame, aliases: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Rewriter:
    """The Rewriter of pairs (pair_id, source, target). It goes to every task, so pairs beyond MOST_PAIRS or MOST_CHARACTERS are
    rejected: a translation table is the work of translators and does not grow with the texts it is applied to."""
    every = with_aliases(pairs.where("source IS NOT NULL AND target IS NOT NULL"), aliases)
    n, characters = every.agg(F.count("*"), F.coalesce(F.sum(F.length("source") + F.length("target")), F.lit(0))).first()
    if n > MOST_PAIRS or characters > MOST_CHARACTERS:
        raise Rejected(f"{n} pairs of {characters} characters are too many for one translation table")
    exact = {r["source"]: r["target"] for r in every.groupBy("source").agg(F.max_by("target", "pair_id").alias("target")).collect()}
    rules = {r["rule_id"]: (r["pattern"], [p.asDict() for p in r["parts"]], r["specificity"], r["anchor"]) for r in compile_rules(every).collect()}
    return Rewriter(exact, rules, prefixes)


def rewrite(texts: DataFrame, pairs: DataFrame, aliases: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(seq, text, target) of texts (seq, text): the rewritten text, null where nothing changes; see Rewriter."""
    shared = texts.sparkSession.sparkContext.broadcast(rewriter(pairs, aliases, prefixes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for b in batches:
            yield b.assign(target=[None if t is None else of(t) for t in b["text"]])

    return texts.select("seq", "text").mapInPandas(run, "seq BIGINT, text STRING, target STRING")
