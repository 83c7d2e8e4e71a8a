"""Word lists and lookup tables used by the text rules and filters.

Everything between the two "fixed values" markers has to stay as it is:
matching results depend on each entry.
"""

# --- fixed values -----------------------------------------------------------

CATEGORIES = [
    "Women - Kurtas", "Women - Dresses", "Women - Jeans & Jeggings", "Women - Tops",
    "Men - Tshirts", "Men - Shirts", "Men - Sneakers", "Women - Kurta Suit Sets",
    "Men - Jackets & Blazers", "Men - Sweatshirts & Jackets", "Men - Jackets & Coats",
    "Infants - Dresses & Frocks", "Girls - Dresses & Frocks", "Girls - 3 Piece-Set",
    "Girls - 2 Piece-Sets", "Boys - 2P-Kurta Sets",
]

# category, threshold as written in the file, status
THRESHOLDS = [
    ("Women - Kurtas", "0.20", "done"),
    ("Women - Dresses", "0.23", "done"),
    ("Women - Jeans & Jeggings", "0.28", "done"),
    ("Women - Tops", "0.30", "done"),
    ("Women - Kurta Suit Sets", "0.20", "done"),
    ("Men - Sweatshirts & Jackets", "0.20", "done"),
    ("Men - Sneakers", "0.30", "done"),
    ("Men - Shirts", "0.27", "done"),
    ("Men - Tshirts", " 0.20", "done"),
    ("Men - Jackets & Coats", "0.25", "done"),
    ("Men - Jackets & Blazers", "0.17", "done"),
    ("Infants - Dresses & Frocks", "0.20", "done"),
    ("Girls - Dresses & Frocks", "0.20", "done"),
    ("Girls - 3 Piece-Sets", "0.20", "done"),
    ("Girls - 2 Piece-Sets", "0.20", "done"),
    ("Boys - 2P-Kurta Sets", "0.15", "done"),
]

NUMBER_WORDS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five",
    "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten",
    "1st": "first", "2nd": "second", "3rd": "third",
    "one": "one", "two": "two", "three": "three", "four": "four", "five": "five",
    "six": "six", "seven": "seven", "eight": "eight", "nine": "nine", "ten": "ten",
}

ORDINAL_ENDINGS = ["st", "nd", "rd", "th"]

PROTECTED_WORDS = """
no not mini maxi mid high low free above below front back a side sole up down on off through
and or full half micro piece t-shirt hem dress skirt pant shoe jacket kurta sneaker coat tee
frock sweatshirt jean jegging hot cold
slim regular loose wide skinny straight cropped over under short long cap cowl polo v-neck round
square boat deep open closed zip button tie faux real pure blend classic modern vintage new old
big small plus petite tall basic print solid stripe check dot floral graphic hood collar sleeve
pocket waist ankle calf knee boot chunky platform
top bottom set pair blouse shirt trouser legging jumpsuit romper swimsuit bikini bra brief sock
stocking scarf shawl hat cap beanie glove mitten belt bag clutch tote crossbody earring necklace
bracelet ring
cotton silk denim wool linen leather suede lace knit woven jersey velvet chiffon polyester nylon
""".split()

# applied one after the other, in this order, as plain substring replacements
PHRASES = [
    ("one piece", "one-piece"), ("two piece", "two-piece"), ("three piece", "three-piece"),
    ("4 piece", "four-piece"), ("5 piece", "five-piece"), ("a line", "a-line"),
    ("v neck", "v-neck"), ("u neck", "u-neck"), ("indo western", "indo-western"),
    ("low top", "low-top"), ("mid top", "mid-top"), ("high top", "high-top"),
    ("crew neck", "crew-neck"), ("scoop neck", "scoop-neck"), ("boat neck", "boat-neck"),
    ("cowl neck", "cowl-neck"), ("polo neck", "polo-neck"), ("sweet heart", "sweetheart"),
    ("off shoulder", "off-shoulder"), ("one shoulder", "one-shoulder"),
    ("cold shoulder", "cold-shoulder"), ("cap sleeve", "cap-sleeve"),
    ("half sleeve", "half-sleeve"), ("full sleeve", "full-sleeve"),
    ("three fourth", "three-fourth"),
    ("regular fit", "regular-fit"), ("slim fit", "slim-fit"), ("skinny fit", "skinny-fit"),
    ("loose fit", "loose-fit"), ("boyfriend fit", "boyfriend-fit"), ("mom fit", "mom-fit"),
    ("high waist", "high-waist"), ("mid rise", "mid-rise"), ("low rise", "low-rise"),
    ("boot cut", "boot-cut"), ("straight cut", "straight-cut"),
    ("cross body", "cross-body"), ("beach wear", "beachwear"), ("foot wear", "footwear"),
    ("sleep wear", "sleepwear"), ("lounge wear", "loungewear"), ("maxi dress", "maxi-dress"),
    ("mini dress", "mini-dress"), ("pencil skirt", "pencil-skirt"), ("ball gown", "ball-gown"),
]

# attribute types whose value already reads as a text of its own
VALUE_ONLY_TYPES = [
    "shop the vibe", "product title", "seasonality", "season", "functional", "sustainability",
]
VALUE_ONLY_VALUES = ["sleeveless"]

CATEGORY_STOP_EXTRA = ["man", "woman", "child", "kid", "boy", "girl", "baby"]

DESCRIPTION_TYPES = [
    "style", "color", "cut", "neckline", "sleeve length", "length", "pattern",
    "seasonality", "trim", "hemline", "sleeve type", "closure", "embroidery",
    "brand", "occasion", "rise", "embellishment", "cartoon / movie character",
    "lining", "upper material", "slit",
    "product title",
]

DENIED_TAGS = [
    "square_toe_shape", "abstract_motif_print", "heritage_motif_print",
    "mirror_work_embellishment", "jacket_style", "sharara_bottom",
]

BATCH_ACTIVE = ["validating", "in_progress", "finalizing"]
BATCH_DONE = ["completed"]
BATCH_ENDED = ["failed", "cancelled", "expired"]

# --- end of the fixed values ------------------------------------------------

# Function words dropped from attribute texts. A caller with a list of their
# own passes it instead.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
s t can will just should now also may might must could would
""".split()

# Plurals the suffix rules would get wrong, and words they must leave alone.
IRREGULAR_LEMMAS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "people": "person", "mice": "mouse", "geese": "goose", "knives": "knife", "scarves": "scarf",
    "leaves": "leaf", "halves": "half", "calves": "calf", "shelves": "shelf", "movies": "movie",
    "hoodies": "hoodie", "beanies": "beanie", "selfies": "selfie", "ties": "tie", "series": "series",
    "species": "species", "canvas": "canvas", "christmas": "christmas", "pyjamas": "pyjamas",
    "me": "me",
    # words in -ie, -che, -us, -i and -s that the rules for plurals would cut elsewhere
    "cookies": "cookie", "onesies": "onesie", "booties": "bootie", "pies": "pie", "zombies": "zombie",
    "niches": "niche", "caches": "cache", "aches": "ache", "axes": "axe", "quizzes": "quiz", "lens": "lens",
    "menus": "menu", "tutus": "tutu", "bikinis": "bikini", "tankinis": "tankini", "saris": "sari", "khakis": "khaki",
    "kurtis": "kurti", "lungis": "lungi", "dhotis": "dhoti", "minis": "mini", "midis": "midi", "maxis": "maxi",
    "safaris": "safari", "taxis": "taxi", "skis": "ski", "bindis": "bindi", "sherwanis": "sherwani",
    "gas": "gas", "bus": "bus", "atlas": "atlas", "bias": "bias", "pajamas": "pajamas",
    # regular verb forms of garment words
    "printed": "print", "striped": "stripe", "checked": "check", "ribbed": "rib", "quilted": "quilt",
    "washed": "wash", "faded": "fade", "ripped": "rip", "pleated": "pleat", "embroidered": "embroider",
    "knitted": "knit", "cropped": "crop", "fitted": "fit", "padded": "pad", "lined": "line", "layered": "layer",
    "ruffled": "ruffle", "belted": "belt", "hooded": "hood", "textured": "texture", "tapered": "taper",
    "flared": "flare", "dyed": "dye", "brushed": "brush", "coated": "coat", "laced": "lace", "buttoned": "button",
    "zipped": "zip", "draped": "drape", "gathered": "gather", "smocked": "smock", "tailored": "tailor",
    "distressed": "distress", "collared": "collar", "embellished": "embellish", "sequined": "sequin",
    "wearing": "wear", "styling": "style", "layering": "layer",
}
