"""Provider usage records, retry delays, buckets and mock markers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: provider -> JSON paths of (input, output, reasoning, cached) token counts.
USAGE_PATHS = {
    "openai": ("$.input_tokens", "$.output_tokens", "$.output_tokens_details.reasoning_tokens", "$.input_tokens_details.cached_tokens"),
    "anthropic": ("$.input_tokens", "$.output_tokens", "$.output_tokens_details.thinking_tokens", "$.cache_read_input_tokens"),
    "gemini": ("$.promptTokenCount", "$.candidatesTokenCount", "$.thoughtsTokenCount", "$.cachedContentTokenCount"),
}
TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens")


def usage(provider: Column, payload: Column) -> Column:
    """struct of TOKENS from a provider's JSON; null where it doesn't say."""
    out = F.lit(None).cast(f"struct<{','.join(f'{t}:bigint' for t in TOKENS)}>")
    for name, paths in USAGE_PATHS.items():
        found = F.struct(*[F.get_json_object(payload, p).cast("bigint").alias(t) for p, t in zip(paths, TOKENS, strict=True)])
        out = F.when(provider == name, found).otherwise(out)
    return out


def retry_delay(attempt: Column, first: float = 0.25, most: float = 2.0) -> Column:
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), attempt))


def bucket(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound that the value doesn't exceed, the last name beyond all."""
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names[:-1], strict=True))):
        out = F.when(value <= bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def is_mock(columns: dict[str, Column]) -> Column:
    """Whether any of a row's markers says that it was made by a mock provider."""
    tests = [F.lower(F.coalesce(c.cast("string"), F.lit(""))).rlike(r"(^|[^a-z])mock([^a-z]|$)|^true$" if name.startswith("mock") else r"(^|[^a-z])mock([^a-z]|$)") for name, c in columns.items()]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
