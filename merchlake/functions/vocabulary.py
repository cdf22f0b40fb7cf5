"""Word lists and ladders whose order is part of their meaning."""

# Chips by tier, first match wins: for recommendation scores
SOC_TIERS = [
    (1.0, ["snapdragon 8 gen 3", "snapdragon 8 gen 2", "apple a19 pro", "apple a19", "dimensity 9300", "tensor g5", "tensor g4"]),
    (0.85, ["snapdragon 8 gen 1", "snapdragon 8s gen 3", "apple a18", "dimensity 9200", "tensor g3"]),
    (0.7, ["snapdragon 7", "dimensity 8", "apple a17", "snapdragon 888", "snapdragon 8 gen 0"]),
    (0.5, ["snapdragon 6", "dimensity 7", "snapdragon 778"]),
]
# Chips by tier, first match wins: for comparison dimensions
CPU_TIERS = [
    (1.0, ["snapdragon 8 gen 3", "snapdragon 8 gen 2", "apple a19 pro", "apple a19", "dimensity 9300", "tensor g5", "tensor g4"]),
    (0.85, ["snapdragon 8s gen 3", "snapdragon 8 gen 1", "apple a18", "a17", "dimensity 9200", "tensor g3"]),
    (0.78, ["snapdragon 8 elite", "snapdragon 8+ gen", "a16", "snapdragon 7+ gen 3", "snapdragon 7+ gen 2", "dimensity 9000"]),
    (0.7, ["snapdragon 888", "snapdragon 870", "dimensity 8", "apple a15"]),
    (0.55, ["snapdragon 7", "dimensity 7", "snapdragon 778", "snapdragon 782", "snapdragon 695"]),
    (0.45, ["snapdragon 6", "dimensity 6", "helio g99", "helio g96"]),
    (0.35, ["helio g85", "helio g35", "helio p35", "unisoc t606", "snapdragon 4"]),
]
# Patterns that are counted, whatever the case
CAMERA_FLAGS = [r"\bOIS\b", "periscope", "telephoto", "8K", "4K", "HDR", r"f/1\.[0-9]", r"sensor[\- ]shift", "large sensor"]
OPTICS_FLAGS = ["leica", "zeiss", "hasselblad", "raw", "prores", "periscope"]
VIDEO_FLAGS = ["4k60", "8k", "prores", "log", "ois", "hdr video"]
COMPARE_CAMERA_FLAGS = [r"\bOIS\b", "periscope", "telephoto", "8K", "4K", "HDR", r"sensor[\- ]shift"]
COMPARE_PHOTO_FLAGS = ["periscope", "telephoto", r"\bOIS\b", r"sensor[\- ]shift", "ProRes", "Dolby Vision", "8K", "large sensor", "RAW", r"HDR\+?", "Pro controls", "evf"]
FOLD_WORDS = ["fold", "flip", "foldable", "flexible"]
FLAGSHIP_AI = ["galaxy ai", "gemini", "apple intelligence"]
FAST_NPU = ["snapdragon 8 gen 3", "snapdragon 8 gen 2", "apple a18", "apple a19", "tensor g4", "dimensity 9300"]
COMPARE_FAST_NPU = ["snapdragon 8 gen 3", "snapdragon 8 gen 2", "apple a18", "apple a19", "tensor g4"]
MIDDLE_NPU = ["snapdragon 7", "tensor", "dimensity 8"]

# Which dimensions an aspect compares
ASPECTS = {
    "camera": ["Camera", "Photography", "Display", "Processor"],
    "software": ["Software", "AI Features", "Processor"],
    "ai": ["AI Features", "Processor", "Software"],
    "ai_feature": ["AI Features", "Processor", "Software"],
    "battery": ["Battery", "Charging", "Display"],
    "value": ["Value", "Processor", "Battery", "Camera"],
}

# Names of specifications, first match wins
SPEC_NAMES = {
    "ram": ["ram", "memory", "system memory"],
    "processor": ["processor", "chipset", "cpu", "soc", "system on chip", "chip"],
    "battery": ["battery", "battery capacity", "battery size", "power", "battery type", "battery info"],
    "rear_camera": ["rear camera", "main camera", "back camera", "primary camera", "rear camera setup", "rear 0.3mp primary camera"],
    "front_camera": ["front camera", "selfie camera", "front facing camera", "selfie"],
    "storage": ["storage", "rom", "internal storage", "memory storage", "storage capacity", "capacity"],
    "display": ["display", "screen", "display size", "screen size", "panel", "display type"],
}

# Questions about a field, first match wins, whatever the case
QUESTION_FIELDS = [
    (r"\b(wireless|qi)\b.*\bcharg(?:e|ing)\b", "wireless_charging"),
    (r"\bram\b", "ram"),
    (r"\bprocessor\b|\bchipset\b|\bsoc\b|\bcpu\b", "processor"),
    (r"\bcharging\b|\bcharger\b|\b(?:fast|quick)\s+charge\b", "charging"),
    (r"\bbattery\b|\bmah\b", "battery"),
    (r"\bdisplay\b|\bscreen\b|\bpanel\b|\bhz\b|\brefresh\b", "display"),
    (r"\bcamera\b|\bphoto(?:graphy)?\b|\bmp\b|\b(?:rear|main)\s+cam", "camera"),
    (r"\bos\b|\bandroid\s+\d+\b|\bios\s+\d+\b", "os"),
    (r"\b5g\b", "network"),
    (r"\bnfc\b", "nfc"),
    (r"\bip6[8]\b|\bwater\s+resist", "water_resistance"),
    (r"\bsd\s*card\b|\bmicro\s*sd\b", "sd_card"),
    (r"\bstor(?:age|e)\b|\brom\b|\b\d+\s*gb\b", "storage"),
]

# Priorities in a request, first match wins; a word must stand alone, a phrase may be part of something
PRIORITIES = {
    "camera": ["camera", "photo", "photography", "selfie", "lens", "video", "recording", "zoom", "megapixel", "mp", "vlogging", "vlog", "telephoto", "low-light", "night", "prores", "raw"],
    "gaming": ["gaming", "game", "pubg", "freefire", "lag-free", "gpu", "graphics", "antutu", "cooling", "triggers"],
    "battery": ["battery", "backup", "charging", "charger", "mah", "life", "standby", "silicon-carbon"],
    "display": ["display", "screen", "amoled", "refresh rate", "hz", "oled", "brightness", "size", "curved", "pwm"],
    "storage": ["storage", "rom", "space", "memory", "expandable", "sd card"],
    "build": ["build", "look", "design", "color", "pretty", "beautiful", "thin", "lightweight", "durable", "waterproof", "ip68", "ip67", "glass", "armor", "rugged", "titanium", "compact", "matte"],
    "value": ["cheap", "value", "affordable", "cheapest", "low cost", "value-for-money"],
    "ai": ["ai", "galaxy ai", "gemini", "apple intelligence", "magic eraser", "translation", "on-device ai", "artificial intelligence"],
    "connectivity": ["esim", "isim", "wifi 7", "wi-fi 7", "satellite", "uwb", "roaming", "5g"],
    "audio": ["stereo speakers", "dolby atmos", "headphone jack", "3.5mm", "mic quality", "musician"],
    "foldable": ["foldable", "fold", "flip", "hinge", "crease"],
    "persona": ["student", "students", "business", "elderly", "senior", "kids", "vlogger", "content creator", "photographer", "musician", "driver", "trading", "freelancer", "e-commerce"],
}
# Words and weights of intents, in order; ties go to the first
INTENT_WORDS = {
    "recommendation": ["best", "recommend", "suggest", "suggestion", "good", "top", "pick", "purchase", "choose"],
    "comparison": ["vs", "versus", "compare", "comparison", "difference", "better", "alternative"],
    "price_lookup": ["price", "cost", "how much", "rate", "worth"],
    "currency": ["tk", "taka", "bdt", "cheap"],
    "availability": ["available", "stock", "in stock", "where to buy", "shop", "store", "delivery"],
    "specification": ["spec", "specs", "specification", "specifications", "feature", "features", "details"],
    "review": ["review", "verdict", "rating", "opinion", "worth buying", "good or bad", "pros and cons", "experience"],
    "lifecycle": ["upcoming", "launch in", "launching", "wait or buy", "should i wait", "upgrade from", "next flagship", "future phone", "upcoming phones", "release date", "launch date"],
    "resale": ["resale", "resale value", "refurbished", "pre-owned", "pre owned", "trade-in", "trade in", "exchange old", "second hand", "used phone", "depreciation", "sell old"],
    "deals": ["emi", "installment", "installments", "warranty", "after-sales", "after sales", "eid sale", "black friday", "daraz sale", "discount", "deal", "deals", "offer", "offers", "bank offer"],
    "general": ["hello", "hi", "hey", "greetings", "who are you", "what can you do", "help", "thank", "thanks"],
}
# Engines that answer an intent, in order
RUBRIC = {
    "recommendation": ["recommend", "buying_guide", "search"],
    "comparison": ["specs", "compare"],
    "specification": ["specs", "search"],
    "price_lookup": ["pricing"],
    "availability": ["pricing"],
    "review": ["review", "search"],
    "mixed": ["recommend", "search"],
    "general": ["search"],
    "lifecycle": ["future_phones", "buying_guide", "search"],
    "resale": ["resale", "pricing", "search"],
    "deals": ["deals", "pricing", "search"],
}
# Scope of a message: brands, words of the domain, patterns in their order; words are runs of letters and digits, so one store's name with a hyphen, which no word can equal, is left out
SCOPE_BRANDS = [
    "samsung", "apple", "iphone", "xiaomi", "redmi", "realme", "vivo", "oppo", "oneplus", "google", "pixel", "infinix", "tecno", "symphony", "nothing", "poco", "iqoo", "asus", "rog",
    "honor", "sony", "xperia", "huawei", "zte", "nubia", "motorola", "moto", "nokia", "ipad", "galaxy", "redmagic",
]
SCOPE_WORDS = [
    "phone", "phones", "mobile", "mobiles", "smartphone", "smartphones", "handset", "cellphone", "telephone", "budget", "price", "prices", "taka", "bdt", "under", "camera", "cameras",
    "gaming", "game", "pubg", "freefire", "processor", "chipset", "ram", "rom", "storage", "gb", "battery", "mah", "charging", "watt", "display", "screen", "amoled", "oled", "lcd", "hz",
    "refreshrate", "fps", "5g", "4g", "esim", "sim", "waterproof", "ip68", "ip67", "stylus", "spen", "foldable", "fold", "flip", "resale", "tradein", "used", "secondhand", "refurbished",
    "emi", "installment", "official", "unofficial", "variant", "snapdragon", "dimensity", "helio", "exynos", "bionic", "antutu", "benchmark", "vlogging", "telephoto", "zoom", "ois", "eis",
    "megapixel", "mp", "speaker", "stereo", "headphone", "jack", "sdcard", "nfc", "wireless", "fastcharging", "fastcharger", "batterytech", "software", "android", "ios", "hyperos", "oneui",
    "oxygenos", "coloros", "update", "updates", "ecosystem", "accessory", "accessories", "cover", "case", "tempered", "glass", "charger", "gadget", "gadgets", "store", "startech",
    "gadgetngear", "diamu", "kry", "compare", "comparison", "versus", "vs", "which", "better", "best", "cheapest", "top", "worth", "buy", "buying", "recommend", "recommendation", "specs",
    "specification", "specifications", "review", "reviews", "upcoming", "launch", "release", "2024", "2025", "2026",
]
SCOPE_PATTERNS = [
    r"\b(iphone|galaxy|pixel|redmi|realme|nord|fold|flip)\s*(\d+|pro|max|ultra|plus|fe|c\d+|note\s*\d+)?\b",
    r"\b\d+\s*(gb|mb|mah|w|hz|mp|bdt|taka|k)\b",
    r"\bunder\s*\d+\b",
    r"\b\d+\s*k\s*(under|budget|taka|bdt)?\b",
    r"\b(vs|versus)\b",
    r"\b(best|cheapest|top)\s+(phone|camera|gaming|battery|display)\b",
]
GREETING = r"^(hi|hello|hey|heythere|hi there|good morning|good afternoon|good evening|assalamu alaikum|assalamualaikum|slam|salaam|greetings|yo|sup|hola)\b"
SMALL_TALK = [
    r"^(how are you|how r u|how do you do|thanks|thank you|thanks a lot|thank u|good job|nice|awesome|great|cool|super cool|who are you|what is your name|what can you do|well done|thankyou|you are awesome)\b",
    r"\b(thank you|thanks|how are you|good job|nice work|awesome|super cool)\b",
]
UNRELATED = [
    r"\b(python|javascript|code|coding|programming|algorithm|java|c\+\+|html|css|sql|database)\b",
    r"\b(world cup|football|messi|ronaldo|cricket|nba|match|score|tournament)\b",
    r"\b(cook|recipe|biryani|food|pasta|pizza|baking|kitchen|dish|ingredients)\b",
    r"\b(joke|funny story|riddle|poem|sing|song|music|lyrics)\b",
    r"\b(resume|cv|cover letter|essay|thesis|homework|math|solve|equation|integral)\b",
    r"\b(weather|temperature|rain|climate|president|capital of|country|history|explain|workout|fitness)\b",
    r"\b(machine learning|deep learning|neural network|physics|chemistry|biology|gravity)\b",
    r"\b(translate|translation|french|german|spanish|bangla|english)\b",
]
QUESTION_START = r"^(who|what is|how to|teach me|tell me|solve|write|translate|give me|explain)\b"
