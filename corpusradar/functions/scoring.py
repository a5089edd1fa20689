"""Signals in the text and the rules that correct model scores. Every function is one column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import contains_any


@dataclass(frozen=True)
class Lexicons:
    """Word lists behind the three signals; matched as substrings."""

    theory: Sequence[str] = field(default_factory=lambda: C.THEORY_WORDS)
    practical: Sequence[str] = field(default_factory=lambda: C.PRACTICAL_WORDS)
    infra: Sequence[str] = field(default_factory=lambda: C.INFRA_WORDS)


@dataclass(frozen=True)
class Signals:
    theory: Column
    practical: Column
    infra: Column


def extract_signals(text: Column, has_code: Column | None = None, lexicons: Lexicons = Lexicons()) -> Signals:
    practical = contains_any(text, lexicons.practical)
    if has_code is not None:
        practical = F.coalesce(has_code, F.lit(False)) | practical
    return Signals(contains_any(text, lexicons.theory), practical, contains_any(text, lexicons.infra))


def rescale_score(score: Column) -> Column:
    """Scores below 1 came on a 0-1 scale."""
    return F.when(score < 1.0, score * 10).otherwise(score)


def domain_cap(score: Column, domain: Column, known: Sequence[str] = C.KNOWN_DOMAINS) -> Column:
    off_domain = ~F.coalesce(domain.isin(list(known)), F.lit(False))
    return F.when(off_domain & (score > 6.0), 6.0).otherwise(score)


def infra_floor(score: Column, signals: Signals) -> Column:
    return F.when(signals.infra & signals.practical & (score < 7.0), 7.0).otherwise(score)


def calibrate_score(score: Column, domain: Column, signals: Signals, known: Sequence[str] = C.KNOWN_DOMAINS) -> Column:
    """Rescale, cap off-domain papers, then lift infra papers with code: in this order."""
    return F.round(infra_floor(domain_cap(rescale_score(score), domain, known), signals), 1)


def action_label(score: Column) -> Column:
    """Action from the score alone; NULL score gives no action."""
    label = F.when(score.isNotNull(), C.ACTION_TOP)
    for limit, name in reversed(C.ACTION_STEPS):
        label = F.when(score < limit, name).otherwise(label)
    return label


def correct_hype(score: Column, signals: Signals) -> Column:
    """Caps for theory and missing practice, floor for infra with practice; NULL stays NULL."""
    capped = F.when(signals.theory & ~signals.practical, F.least(score, F.lit(3.0))).otherwise(score)
    capped = F.when(~signals.practical, F.least(capped, F.lit(5.0))).otherwise(capped)
    capped = F.when(signals.practical & ~signals.infra, F.least(capped, F.lit(6.0))).otherwise(capped)
    lifted = F.when(signals.infra & signals.practical, F.greatest(capped, F.lit(7.0))).otherwise(capped)
    return F.when(score.isNotNull(), F.round(lifted, 1))


def hidden_gem(score: Column, hype: Column) -> Column:
    return F.coalesce((score >= 7.0) & (hype <= 4.0), F.lit(False))


def overhyped(score: Column, hype: Column) -> Column:
    return F.coalesce((hype >= 7.0) & (score < 5.0), F.lit(False))


def generic_reason(reason: Column, phrases: Sequence[str] = C.GENERIC_REASON_PHRASES) -> Column:
    return contains_any(reason, phrases)
