from concilia.functions.dates import (  # noqa: F401
    br_date_text, deadline_passed, older_than_days, parse_two_format_date,
)
from concilia.functions.text import (  # noqa: F401
    alnum_upper, company, compose_code, cut, digits_only, first_present, has_digit,
    has_illegal_character, is_blank, is_cpf, is_present, nullif_blank, same_name, upper_trim,
    word_count,
)
