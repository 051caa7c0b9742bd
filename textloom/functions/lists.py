"""Word lists used as default arguments (fixed values); every operator takes its own list instead."""

STOP = "the of and to in is that for it as was on are by this be with from or an at le la les de des du et un une en que qui est dans pour par sur pas au avec der die das und ist von zu den mit sich des auf ein eine nicht el los las y en con para del se al lo como no una".split()
PHRASES = ["it is worth", "in summary", "of the", "the and"]
SHOP = ["add to cart", "checkout", "wishlist"]
#: Stylesheet and markup remains, removed in this order (fixed values).
CSS = [r"\{[^{}]*\}", r"@[a-zA-Z-]+[^;{<]*;", r"<[^>]+>", r"(?:rgba?|url|calc|var)\([^)]*\)", r"#[0-9a-fA-F]{3,8}\b", r"\b\d+(?:\.\d+)?(?:px|em|rem|vh|vw)\b"]
#: Kinds of hard facts and how they are written (fixed values).
FACTS = {"percent": r"\d+(?:[.,]\d+)?\s?%", "price": r"[$€£]\s?\d+(?:[.,]\d+)*", "date": r"\b\d{4}-\d{2}-\d{2}\b", "measure": r"\b\d+(?:[.,]\d+)?\s?(?:kg|km|cm|mm|ml|mg)\b"}
#: Letter ranges of scripts and how many runs of each are reported (fixed values).
SCRIPTS = {"cyrillic": (r"[\x{0400}-\x{04FF}]+", 5), "cjk": (r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+", 3), "arabic": (r"[\x{0600}-\x{06FF}]+", 3)}
ENTITIES = [("mit license", "PRODUCT"), ("apache license", "PRODUCT"), ("gnu general public license", "PRODUCT"), ("the", "CONCEPT"), ("than the", "CONCEPT"), ("idiot", "PERSON")]
BUDGETS = [("the", 1, 20), ("license", 1, 2), ("than", 2, 6), ("idiot", 0, 0)]
#: Written forms and their lemmas (fixed values).
LEXICON = [("licenses", "license"), ("licensed", "license"), ("words", "word"), ("les", "le"), ("las", "la"), ("des", "de"), ("das", "der"), ("die", "der")]
BANNED = ["worth it", "is the", "pour le"]
STYLE_STOP = ["the", "a", "in", "le", "de"]
PART_ENTITIES = ["the", "license"]
#: Phrases with a range of uses and a weight (fixed values); None is the variant's own upper limit.
WEIGHTED = [("the", 1, 20, 0.5), ("license", 1, 2, 0.4), ("than", 2, None, 0.2), ("idiot", 0, 0, 0.1), ("with", 3, None, 0.35), ("apache license", 1, 3, 0.6), ("la", 1, None, 0.9)]
