"""Fixed values of the normaliser: they decide results, so they are stated as they are."""

from __future__ import annotations

# First code point of the nine Indic blocks; all share one layout of 128 places.
INDIC_BLOCKS = [0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00]

# Place in a block -> Latin reading.
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "d", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
VOWELS = {
    0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li",
}
VOWEL_SIGNS = {
    0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li",
}
SIGNS = {0x01: "n", 0x02: "n", 0x03: "h", 0x50: "om", 0x70: "n"}
MALAYALAM = 0x0D00
MALAYALAM_CHILLU = {0x54: "m", 0x55: "y", 0x56: "l", 0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k"}
MALAYALAM_CONJUNCTS = [("റ്റ", "ട്ട"), ("ന്റ", "ന്ട")]
SILENT = [0x00, 0x3C, 0x3D, 0x4E, 0x57, 0x64, 0x65]
VIRAMA = 0x4D
FIRST_DIGIT = 0x66

# Words of business names and their long forms.
NAME_ABBREVIATIONS = {
    "corp": "corporation", "co": "company", "inc": "incorporated", "ltd": "limited", "pvt": "private",
    "pvtltd": "private limited", "intl": "international", "mfg": "manufacturing", "svcs": "services", "svc": "service",
    "assn": "association", "assoc": "associates", "bros": "brothers", "dept": "department", "univ": "university",
    "natl": "national", "mgmt": "management", "tech": "technologies", "grp": "group", "ent": "enterprises",
    "cie": "compagnie", "ste": "societe", "sté": "societe", "fr": "freres",
}

# Words that are no part of a name's core.
LEGAL_WORDS = [
    "incorporated", "corporation", "company", "limited", "private", "llc", "llp", "pllc", "plc", "lp", "ltd", "inc", "pvt",
    "corp", "co", "the", "and", "of", "dba", "mr", "mrs", "ms", "dr", "sri", "shri", "shree", "m/s", "ms.", "sarl", "sas",
    "sasu", "eurl", "sa", "sci", "snc", "scop", "selarl", "gmbh", "ei", "cie", "compagnie", "de", "du", "des", "la", "le",
    "les", "et", "l", "d", "pa", "pc",
]

# Words and phonetic skeletons of legal forms, and their class.
LEGAL_CLASSES = {
    "llc": "llc", "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "limited": "ltd", "ltd": "ltd",
    "private": "pvt", "pvt": "pvt", "llp": "llp", "pllc": "pllc", "plc": "plc", "lp": "lp", "pc": "pc", "pa": "pa",
    "company": "co", "co": "co", "public": "public", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa",
    "sci": "sci", "snc": "snc", "gmbh": "gmbh", "ei": "ei", "prvt": "pvt", "lmtd": "ltd", "krprshn": "corp",
    "krprsn": "corp", "kmpn": "co",
}
LEGAL_SKELETONS = ["prvt", "lmtd", "lmt", "nkrprtd", "krprshn", "krprsn", "kmpn", "lmtdd"]

# Rewrites of the phonetic skeleton, in order.
PHONETIC_REWRITES = [
    ("tion", "shn"), ("sion", "shn"), ("ph", "f"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("c(?=[eiy])", "s"), ("c", "k"),
    ("w", "v"), ("z", "j"), ("(?<=[kgcjtdpb])h", ""), ("sh", "s"), ("ee", "i"), ("oo", "u"),
]

# Noise in names and its replacement, in order; the web ending also marks a domain.
WEB_ENDINGS = "com|in|net|org|co|fr|io|biz"
NAME_NOISE = [
    (r"\((?:id|ref|no)[:\s#]*[\w-]+\)", " "), (r"#\s*\d+", " "), (r"\|.*$", " "),
    (rf"\b(?:www\.)?[a-z0-9-]+\.(?:{WEB_ENDINGS})\b", " "),
    (r"\bl\.l\.c\.?", "llc"), (r"\bl\.l\.p\.?", "llp"), (r"\bs\.a\.s\.?", "sas"), (r"\be\.u\.r\.l\.?", "eurl"), (r"\bs\.a\.r\.l\.?", "sarl"),
]

# Words of addresses and their long forms, and words that carry nothing.
ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard",
    "dr": "drive", "ln": "lane", "ct": "court", "cir": "circle", "trl": "trail", "hwy": "highway", "pkwy": "parkway",
    "pl": "place", "sq": "square", "ter": "terrace", "cres": "crescent", "apt": "unit", "ste": "unit", "suite": "unit",
    "apartment": "unit", "fl": "floor", "flr": "floor", "bldg": "building", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount", "ft": "fort",
    "r": "rue", "ch": "chemin", "imp": "impasse", "all": "allee", "pte": "porte", "opp": "opposite", "nr": "near",
    "nagr": "nagar", "mg": "mahatma gandhi",
}
ADDRESS_STOPS = [
    "no", "door", "h", "hno", "house", "plot", "unit", "po", "box", "null", "na", "c/o", "co", "near", "opposite", "and",
    "the", "of", "de", "du", "des", "la", "le", "kh", "sno", "gala", "shop", "flat", "floor", "building", "region",
]
NUMBER = r"\d+[a-z]?(?:/\d+[a-z]?)*"
