"""Column-level helpers (inventory section 2.7).  All are built-in Spark
expressions, so they stay inside whole-stage code generation."""

from cartwise.functions.arrays import (  # noqa: F401
    concat_arrays, first_item, jaccard, slice_head, sorted_set, unique,
)
from cartwise.functions.dates import (  # noqa: F401
    month_start, year_month_key, year_of, month_of,
)
from cartwise.functions.text import (  # noqa: F401
    describe_bundle, like, list_text, name_prefix, not_blank, parse_list_text,
    rule_text, split_text, trim_text, truncate_label,
)
