from hubtrace.functions.columns import (
    bucketize,
    day_number,
    known,
    safe_ratio,
    text_of,
)

__all__ = ["bucketize", "day_number", "known", "safe_ratio", "text_of"]
