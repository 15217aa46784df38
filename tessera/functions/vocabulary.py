"""The word lists and tables that results must agree on, in their natural order."""

# Words that alone do not make a business name.
STOP_WORDS = ("the", "a", "an", "and", "of", "for", "le", "la", "les", "l", "d", "de")

# Legal forms, English; longer forms with the same ending come first.
SUFFIXES_EN = (
    "private limited company", "private limited", "private ltd", "pvt limited", "pvt ltd", "limited liability partnership",
    "limited liability company", "limited partnership", "professional corporation", "sole proprietorship", "public limited company",
    "public limited", "co ltd", "company limited", "pvt co",
    "incorporated", "corporation", "associates", "cooperative", "proprietor", "proprietorship", "holding", "holdings", "company",
    "limited", "private", "group", "assoc", "pllc", "llc", "llp", "inc", "corp", "ltd", "pvt", "co", "lp", "pc",
)

# Legal forms, French.
SUFFIXES_FR = (
    "societe a responsabilite limitee", "societe par actions simplifiee unipersonnelle", "societe par actions simplifiee",
    "societe en commandite par actions", "societe en commandite simple", "societe en nom collectif", "societe civile immobiliere",
    "societe civile professionnelle", "societe anonyme", "groupement d interet economique", "entreprise unipersonnelle a responsabilite limitee",
    "sarl", "sasu", "sas", "eurl", "sci", "snc", "gie", "sca", "scs", "scp", "sa", "ste",
)

# Legal forms, Hindi.
SUFFIXES_HI = ("प्राइवेट लिमिटेड", "प्राइवेट लि", "प्रा लि", "प्रा. लि.", "लिमिटेड", "लि.", "लि", "कंपनी", "कॉर्पोरेशन")

# The short form of a legal form; forms that are not here have none.
SUFFIX_CANONICAL = {
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "limited liability company": "llc", "llc": "llc",
    "limited liability partnership": "llp", "llp": "llp", "limited": "ltd", "ltd": "ltd", "private limited company": "pvt ltd",
    "private limited": "pvt ltd", "private ltd": "pvt ltd", "pvt limited": "pvt ltd", "pvt ltd": "pvt ltd", "private": "pvt ltd",
    "pvt": "pvt ltd", "company": "co", "co": "co", "co ltd": "ltd", "company limited": "ltd", "sarl": "sarl",
    "societe a responsabilite limitee": "sarl", "sas": "sas", "societe par actions simplifiee": "sas", "sasu": "sasu", "sa": "sa",
    "societe anonyme": "sa", "sci": "sci", "eurl": "eurl", "ste": "ste", "प्राइवेट लिमिटेड": "pvt ltd", "प्रा लि": "pvt ltd",
    "प्रा. लि.": "pvt ltd", "लिमिटेड": "ltd", "लि": "ltd", "लि.": "ltd", "कंपनी": "co", "कॉर्पोरेशन": "corp",
}

# Address words and their short forms; boulevard is bd, as its French entry is the later one.
ADDRESS_SHORT = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "boulevard": "bd", "boul": "blvd", "road": "rd", "drive": "dr",
    "lane": "ln", "court": "ct", "circle": "cir", "highway": "hwy", "parkway": "pkwy", "square": "sq", "place": "pl", "terrace": "ter",
    "suite": "ste", "apartment": "apt", "building": "bldg", "floor": "fl", "unit": "unit", "taluk": "tq", "taluka": "tq",
    "district": "dist", "opposite": "opp", "near": "nr", "behind": "bh", "sector": "sec", "phase": "ph", "nagar": "nagar",
    "colony": "colony", "marg": "marg", "rue": "r", "bld": "bd", "allee": "all", "impasse": "imp", "chemin": "che", "route": "rte",
}

# Name words that make no blocking key.
NAME_STOP_TOKENS = (
    "the", "a", "an", "and", "of", "for", "in", "at", "on", "to", "by", "with", "co", "corp", "inc", "ltd", "llc", "llp", "pvt",
    "limited", "company", "de", "la", "le", "les", "du", "des", "et", "en", "sur",
)

# Address words that make no blocking key.
ADDRESS_STOP_TOKENS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "circle", "cir", "highway", "hwy",
    "way", "parkway", "pkwy", "suite", "ste", "unit", "floor", "fl", "building", "bldg", "room", "rm", "near", "nr", "opp",
    "opposite", "behind", "bh", "city", "state", "town", "post", "box", "po", "and", "the", "of", "in", "at", "to", "for", "on",
    "north", "south", "east", "west", "central", "main", "new", "old", "first", "village", "nagar", "colony", "block", "sector",
    "phase", "plot", "shop",
)

# One of these, at the start of a name, is left out of a second exact key.
HONORIFICS = ("mr", "mrs", "ms", "dr", "shri", "smt", "m/s", "messrs", "llp", "pvt ltd")

# Combining marks that accent stripping removes.
MARK_RANGES = ((0x0300, 0x036F), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
