"""Word lists, patterns and names that results depend on."""

#: Separators that become spaces. Fixed values.
SEPARATORS = r"[-_/\\.,()|\[\]{}+:;]+"

#: Words without a part in identifying a product. Fixed values.
NOISE_WORDS = (
    "gpu", "tarjeta", "video", "placa", "de", "pcie", "pci", "express", "ssd", "nvme", "disco", "solido", "m2", "gen", "4x4",
    "gddr6x", "gddr6", "gddr5x", "gddr5", "gddr4", "gb", "tb", "bit", "bits", "hdmi", "displayport", "dport", "vga", "dvi", "gaming", "edition", "series",
)

#: Ordered token rewrites (pattern, replacement with \1 groups); all ignore case. Fixed values.
TOKEN_REWRITES = (
    (r"\bRTX\s*(\d{4})\s*Ti\b", r"RTX \1 Ti"),
    (r"\bRTX\s*(\d{4})\s*Super\b", r"RTX \1 Super"),
    (r"\bRTX\s*(\d{4})\b", r"RTX \1"),
    (r"\bR\s*(\d{4})\s*XT\b", r"RX \1 XT"),
    (r"\bRX\s*(\d{4})\s*XT\b", r"RX \1 XT"),
    (r"\bRX\s*(\d{4})\b", r"RX \1"),
    (r"\bArc\s*([AB]\d{3})\b", r"Arc \1"),
    (r"\bGTX\s*(\d{3,4})\b", r"GTX \1"),
    (r"\bG\s*(\d{3})\b", r"GT \1"),
    (r"\bGT\s*(\d{3})\b", r"GT \1"),
    (r"\bPC\s*(\d{3,5})\b", r"\1MHz"),
    (r"\bPC([345])\s*(\d{3,5})\b", r"\2MHz"),
    (r"\bPCIe\s+\d\s+0\b", ""),
    (r"\bGen\s*\d+\s*x\s*\d+\b", ""),
    (r"\bM\s*\.?\s*2\b", "m2"),
    (r"\b(\d+)\s+GB\b", r"\1GB"),
    (r"\b(\d+)\s+TB\b", r"\1TB"),
    (r"\b(\d+)\s*GB\s+(DDR[345])\s+(\d{3,5})(?:\s*MHz)?\b", r"\2 \1GB \3MHz"),
)

#: What a title holds if any of these rewrites finds something: first rewrite, last one, pattern. Titles without it skip them, which changes no result.
REWRITES_NEED = (
    (0, 15, r"(?i)\b(?:R(?:TX|X)?\s*\d{4}|Arc\s*[AB]\d|G(?:TX|T)?\s*\d{3}|PC\s*\d{3}|PC[345]\s*\d|PCIe\s+\d|Gen\s*\d|M\s*\.?\s*2\b)"),
    (15, 18, r"(?i)\d\s+[GT]B\b|\d\s*GB\s+DDR[345]"),
)

#: Board makers by their words, in order: the first maker with any word in the title counts. Fixed values.
BRAND_WORDS = (
    ("ASUS", ("asus", "rog", "tuf", "dual", "prime")),
    ("MSI", ("msi",)),
    ("Gigabyte", ("gigabyte", "aorus", "windforce", "eagle")),
    ("Palit", ("palit", "stormx", "gamerock", "gamingpro")),
    ("Zotac", ("zotac", "twin", "amp")),
    ("ASRock", ("asrock",)),
    ("XFX", ("xfx", "swift", "speedster")),
    ("Biostar", ("biostar",)),
    ("Sapphire", ("sapphire", "pulse", "nitro")),
    ("PowerColor", ("powercolor", "hellhound", "fighter")),
    ("PNY", ("pny",)),
    ("Arktek", ("arktek",)),
)

#: Product lines of a maker, in order. Fixed values.
VARIANT_PHRASES = (
    ("ASUS", ("rog strix", "tuf gaming", "tuf", "dual", "prime", "proart", "cerberus", "phoenix")),
    ("MSI", ("gaming x trio", "gaming x", "gaming", "ventus", "suprim", "mech", "aero")),
    ("Gigabyte", ("aorus", "windforce", "eagle", "gaming oc", "gaming", "vision", "master", "xtreme")),
    ("Palit", ("stormx", "gamerock", "gamingpro oc", "gamingpro", "jetstream", "dual")),
    ("Zotac", ("twin edge oc", "twin edge", "amp extreme", "amp", "gaming")),
    ("Sapphire", ("nitro+", "nitro", "pulse", "pure")),
    ("PowerColor", ("hellhound", "fighter", "red devil", "red dragon")),
    ("XFX", ("speedster", "swift", "merc", "qick")),
    ("ASRock", ("challenger", "phantom gaming", "taichi", "steel legend", "creator")),
)

#: Model patterns in the order they are tried; all ignore case. Fixed values.
MODEL_PATTERNS = (
    r"\bRTX\s*(\d{4})\s*(Ti|Super|Ultra)?\b",
    r"\bR[Xx]?\s*(\d{4})\s*(XT)?\b",
    r"\bradeon\s*(\d{4})\b",
    r"\bgeforce\s*(\d{4})\b",
    r"\bGV-R(\d{3,4})X",
    r"\bArc\s*([AB]\d{3})\b",
    r"\bGTX\s*(\d{3,4})\b",
    r"\bRyzen\s*([3579])\s*(\d{4})([A-Z0-9]*)\b",
    r"(?:^|[\s/])R([3579])(\d{4})([A-Z]*)(?:[\s/]|$)",
    r"\bAthlon\s*(\d{4})G\b",
    r"\bIntel\s*Core\s*i([3579])[- ]?(\d{4,5})([A-Za-z]*)\b",
    r"\bi([3579])(\d{4,5})([A-Z]*)\b",
    r"\b(DDR[345])\s*(\d+)\s*GB\s*(\d{3,5})(?!\d)",
    r"\b(\d+)\s*GB\s*(DDR[345])\s*(\d{3,5})(?!\d)",
    r"\b(DDR[345])\s*(\d+)\s*GB\b",
    r"\bKINGSTON\s+(NV[23])\s+(\d+)(GB|TB)\b",
    r"\bKINGSTON\s+(A400)\s+(\d+)(GB|TB)\b",
    r"\bSSD\s+(\d+)(GB|TB)\b",
)

#: What a title holds if any of the model patterns finds something.
MODELS_NEED = (
    r"(?i)\b(?:R(?:TX|X)?\s*\d{4}|(?:radeon|geforce|athlon)\s*\d{4}|GV-R\d|Arc\s*[AB]\d|GTX\s*\d|Ryzen\s*[3579]|Intel\s*Core\s*i|i[3579]\d{4}|DDR[345]\s*\d+\s*GB|\d+\s*GB\s*DDR[345]|KINGSTON\s|SSD\s+\d)"
)

#: Ordered rewrites of a found model, upper case, into the catalogue's form. Fixed values; a table, because the queries and their SQL both run it.
MODEL_REWRITES = (
    (r"\s+", " "),
    (r"^R(\d)", r"RX \1"),
    (r"^RADEON\s+(\d{4})$", r"RX \1"),
    (r"^GEFORCE\s+(\d{4})$", r"RTX \1"),
    (r"^GV-R906X$", "RX 9060 XT"),
    (r"^GV-R907X$", "RX 9070 XT"),
    (r"^R([3579])(\d{4})([A-Z]*)$", r"Ryzen \1 \2\3"),
    (r"^I([3579])(\d{4,5})([A-Z]*)$", r"Intel Core i\1 \2\3"),
    (r"^INTEL\s*CORE\s*I([3579])[-](\d{4,5})([A-Za-z0-9]*)$", r"Intel Core i\1 \2\3"),
    (r"^(INTEL CORE I[3579] \d{4,5})[A-Z].*$", r"\1"),
    (r"(?i)^ATHLON\s*(\d{4})G\b", r"AMD Athlon \1G"),
    (r"^(\d+)GB (DDR[345]) (\d{3,5})$", r"\2 \1GB \3"),
    (r"(RTX|RX|GTX|Arc)(\d)", r"\1 \2"),
    (r"(?i)(\d)(Ti|XT|Super|Ultra)$", r"\1 \2"),
)

#: Query parameters that say where a visitor came from. Fixed values.
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid")

#: Confidence of each way to match. Fixed values.
EXACT_CONFIDENCE, PATTERN_CONFIDENCE, FUZZY_THRESHOLD = 1.0, 0.9, 0.8

#: Marks of the signals on a display. Fixed values.
SIGNAL_MARKS, UNKNOWN_MARK = {"deal": "🟢", "fair": "🟡", "expensive": "🔴"}, "⚪"

#: Words of the common graphics models in a title. Fixed values.
GRAPHICS_WORDS = r"(?i)RTX|RX\s?\d|Arc\s?[AB]|Radeon|GeForce|GTX"
