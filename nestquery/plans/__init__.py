"""From query text to a DataFrame: lexer, syntax tree, parser, parameters, compiler."""
