"""Operators for training-data pipelines (chat formatting, secrets, near copies,
language, tokens, decontamination, language models). Nothing outside this
subpackage imports it; queries are listed in ``registry``."""
