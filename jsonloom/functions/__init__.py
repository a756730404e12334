"""Row-local column functions: lexing, scalars, strings, errors."""
