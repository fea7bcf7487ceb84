"""op4: token counts of all documents before and after numbers and addresses are redacted."""

import public_tokenizers

from . import tokencount
from .common import stored, table

#: Runs of digits (with dots: addresses of machines), mail addresses and long hexadecimal strings.
PRIVATE = r"[0-9][0-9.]{5,}[0-9]|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9a-f]{24,}"
#: Every match of PRIVATE holds such digits, an "@" or such a run, so other texts need no search for edits.
HINT = r"[0-9][0-9.]{5}|@|[0-9a-f]{24}"


def op4_token_counts(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = stored(tokencount.build(table(spark, sf_dir, "documents"), path, pattern), "trees", "zstd")
    return tokencount.apply_edits(tokencount.redactions(trees, PRIVATE, "[redacted]", HINT), path, pattern)
