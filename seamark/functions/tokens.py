"""Token counts without a tokenizer: weighted character classes, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import let, struct

# Weights of the heuristic token counter.
DEFAULT_CHARS_PER_TOKEN = 4.0
PUNCTUATION_WEIGHT = 0.8
OTHER_WEIGHT = 0.9
WHITESPACE_WEIGHT = 0.1

# Fixed value: share of the hard token limit a chunk is filled to.
SOFT_LIMIT_SHARE = 0.9

# Runs, not single characters: one match per word keeps the regex engine out of the way.
_WORD = r"[\p{IsAlphabetic}\p{N}]+"
_SPACE = r"\p{IsWhite_Space}+"
_PUNCT = r"[!-/:-@\[-`{-~]+"


def class_counts(content: Column) -> Column:
    """Struct (word, space, punct, other) of character counts; counts of texts add up."""
    rest = lambda text, pattern: F.regexp_replace(text, pattern, "")
    return let(
        rest(content, _WORD),
        lambda a: let(
            rest(a, _SPACE),
            lambda b: let(
                rest(b, _PUNCT),
                lambda c: struct(
                    word=F.char_length(content) - F.char_length(a),
                    space=F.char_length(a) - F.char_length(b),
                    punct=F.char_length(b) - F.char_length(c),
                    other=F.char_length(c),
                ),
            ),
        ),
    )


def tokens_from_counts(counts: Column, chars_per_token: float = DEFAULT_CHARS_PER_TOKEN) -> Column:
    estimate = (
        counts["word"] / F.lit(float(chars_per_token))
        + counts["punct"] * F.lit(PUNCTUATION_WEIGHT)
        + counts["other"] * F.lit(OTHER_WEIGHT)
    ) + counts["space"] * F.lit(WHITESPACE_WEIGHT)
    return F.ceil(estimate).cast("int")


def token_count(content: Column, chars_per_token: float = DEFAULT_CHARS_PER_TOKEN,
                calibration: dict[str, int] | None = None) -> Column:
    """Estimated tokens; texts in `calibration` return the count recorded there."""
    estimate = let(class_counts(content), lambda counts: tokens_from_counts(counts, chars_per_token))
    if not calibration:
        return estimate
    known = F.create_map(*[F.lit(x) for text, n in calibration.items() for x in (text, int(n))])
    return F.coalesce(F.try_element_at(known, content), estimate)


def calibrated_ratio(samples: dict[str, int]) -> float:
    """Bytes per token over texts of known token count."""
    total = sum(samples.values())
    return sum(len(t.encode()) for t in samples) / total if total > 0 else DEFAULT_CHARS_PER_TOKEN


def soft_limit(max_tokens: int) -> int:
    return int(max_tokens * SOFT_LIMIT_SHARE)
