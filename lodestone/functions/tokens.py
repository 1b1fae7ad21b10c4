"""The 32 token codes and what they stand for in each context."""

# Fixed values of the format: what codes 0..27 stand for in the contexts number, word, lower case, punctuation.
DIGITS = "0123456789"
OPERATORS = "+-*/=()"  # codes 10..16 in number context
POWER, SCALE = 26, 27  # ^ and S in number context; codes 17..25 there are the digits -1..-9
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ ."
LOWER = "abcdefghijklmnopqrstuvwxyz@-"
PUNCTUATION = "!\"#$%&'()*+,/:;<=>?[\\]^_`{|}"
COMMANDS = ("AUTH", "GRANT_R", "GRANT_W", "REVOKE", "ENCRYPT", "LABEL")  # codes 0..5 below punctuation
RECORD, CHECKSUM, END, START = 28, 29, 30, 31

SYMBOL_CODE = {s: 10 + i for i, s in enumerate(OPERATORS)} | {"^": POWER, "S": SCALE}
