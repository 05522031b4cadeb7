"""Operations for preparing language-model training data at scale.

One module per operator; ``queries`` applies each to its whole table.
Nothing outside this subpackage imports it.
"""
