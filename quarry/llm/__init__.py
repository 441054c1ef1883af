"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries.  Shared conventions, unless a docstring says otherwise:

* a null text counts as the empty text, a null key as an ordinary key;
* only the columns an operator names are read, so additional columns of any
  name are ignored or, where an operator returns its input, passed through;
* an empty table gives an empty result with the same schema.
"""
