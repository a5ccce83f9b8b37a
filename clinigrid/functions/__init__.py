from clinigrid.functions.aggregates import (
    count_where, max_strict, mean_strict, sum_or_zero, sum_strict,
)
from clinigrid.functions.columns import (
    apply_across, clean_name, clean_names, columns_matching, drop_all_missing,
    front, literal, numeric_columns,
)
from clinigrid.functions.scalars import (
    bucket_label, capitalise, epi_week, epi_year_week, first_match_label, geo_key,
    label_lookup, matches, missing_to_zero, not_in, pad_left, per, percent, ratio,
    to_day, to_number, wave_days, wave_label, week_ordinal,
)
