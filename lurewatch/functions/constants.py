"""Fixed values.

Everything in this module is a fixed value that has to be exactly this for
results to be right: word lists, lookup tables and field names.  Order matters
wherever a rule says "first match wins" (brands) or "first n entries".
"""

from __future__ import annotations

import os
import unicodedata

# --- Protected brand names; list order decides ties. Fixed values. ---
BRANDS = (
    "google", "facebook", "amazon", "apple", "microsoft", "netflix",
    "paypal", "ebay", "instagram", "twitter", "linkedin", "youtube",
    "github", "stackoverflow", "reddit", "wikipedia", "whatsapp",
    "snapchat", "tiktok", "discord", "spotify", "uber", "airbnb",
    "dropbox", "adobe", "zoom", "slack", "stripe", "shopify",
    "walmart", "target", "bestbuy", "costco", "homedepot",
    "bankofamerica", "wellsfargo", "chase", "citi", "usaa",
    "hsbc", "barclays", "lloyds", "natwest", "santander",
    "irs", "usps", "fedex", "ups", "dhl",
    "roblox", "steam", "epic",
)

# --- Extra brands used only by the corpus generators. Fixed values. ---
EXTRA_GENERATOR_BRANDS = (
    "coinbase", "binance", "kraken",
    "venmo", "zelle", "cashapp", "samsung", "sony",
    "dell", "hp", "lenovo", "asus", "nvidia", "amd", "intel",
    "tesla", "bmw", "mercedes", "ford", "toyota", "honda",
)

# --- Top-level domains by reputation. Fixed values. ---
SUSPICIOUS_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "ru", "cn", "top", "xyz", "country",
    "buzz", "icu", "cam", "rest", "surf", "mom",
    "shop", "click", "sbs", "cfd", "digital", "help",
    "live", "life", "fun", "site", "store", "rent",
)
TRUSTED_TLDS = (
    "com", "org", "net", "edu", "gov", "io", "co", "us", "uk", "de",
    "fr", "jp", "au", "ca", "nl", "se", "no", "fi", "dk", "at",
    "ch", "be", "it", "es", "pt", "pl", "cz", "ro", "hu", "bg",
    "hr", "sk", "si", "lt", "lv", "ee", "ie", "nz", "za", "br",
    "mx", "ar", "cl", "pe", "in", "sg", "hk", "tw", "kr",
    "me", "tv", "cc", "ws", "to", "ai",
)

# --- Words combined with brands on phishing hosts. Fixed values; the server
# rules use the first 15 / first 12, the browser rules the first 20. ---
COMBO_WORDS = (
    "secure", "login", "verify", "auth", "account", "bank", "update",
    "confirm", "wallet", "crypto", "pay", "mail", "web", "portal",
    "center", "hub", "official", "team", "support", "service",
    "online", "access", "identity", "session", "token",
)

# --- Words before / after a brand. Fixed values. ---
SUSPICIOUS_PREFIXES = (
    "secure", "login", "verify", "auth", "account", "bank", "update",
    "confirm", "wallet", "crypto", "pay", "mail", "web", "portal",
    "my", "app", "admin", "panel", "console", "dashboard",
)
SUSPICIOUS_SUFFIXES = (
    "secure", "login", "verify", "auth", "account", "bank", "update",
    "confirm", "wallet", "crypto", "pay", "center", "hub", "portal",
    "service", "support", "help", "team", "staff", "official",
)

# --- Keywords counted in the whole URL. Fixed values. ---
SUSPICIOUS_KEYWORDS = (
    "login", "signin", "verify", "verification", "account", "password",
    "secure", "bank", "update", "confirm", "wallet", "paypal", "apple",
    "microsoft", "google", "amazon", "ebay", "netflix", "crypto", "reset",
    "otp", "2fa", "authenticate",
)

# --- Hosting platforms and link shorteners. Fixed values. ---
FREE_HOSTING = (
    "github.io", "gitbook.io", "appspot.com", "firebaseapp.com",
    "netlify.app", "vercel.app", "pages.dev", "workers.dev",
    "herokuapp.com", "glitch.me", "repl.co", "codesandbox.io",
    "weebly.com", "wixsite.com", "wordpress.com", "blogspot.com",
    "webs.com", "yolasite.com", "ucraft.com", "strikingly.com",
    "carrd.co", "linktr.ee", "beacons.ai", "bio.link",
)
BROWSER_FREE_HOSTS = (
    "github.io", "gitbook.io", "appspot.com", "netlify.app",
    "vercel.app", "pages.dev", "herokuapp.com", "weebly.com",
)
SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd",
    "buff.ly", "adf.ly", "shorturl.at", "cutt.ly",
)

# --- Path and file patterns. Fixed values. ---
ADMIN_PATHS = ("/wp-admin", "/wp-login", "/cgi-bin", "/admin",
               "/phpmyadmin", "/cpanel", "/webmail", "/phpinfo")
SUSPICIOUS_PATHS = ("/login", "/signin", "/verify", "/secure", "/account",
                    "/update", "/confirm", "/reset", "/auth", "/session")
SUSPICIOUS_EXTENSIONS = (".php", ".exe", ".bat", ".cmd", ".scr", ".pif",
                         ".com", ".hta", ".vbs", ".js", ".wsf")
INTERNAL_SCHEMES = ("chrome", "chrome-extension", "about", "edge",
                    "moz-extension", "safari-extension")

# --- Known-legitimate domains (search, social, media, developer, shop, bank, school and
# government sites). Fixed values, kept as a text file; the reputation table is a parameter
# of every operator that uses it. ---
def _listed(name: str) -> tuple[str, ...]:
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources", name)
    with open(path, encoding="utf-8") as f:
        return tuple(x for x in f.read().split("\n") if x and not x.startswith("#"))


KNOWN_DOMAINS = _listed("known_domains.txt")

#: Characters that become a delimiter of URLs when a host is normalised (NFKC), by that rule.
DELIMITER_LIKE = "".join(c for c in map(chr, range(0x80, 0x30000))
                         if set(unicodedata.normalize("NFKC", c)) & set("/?#@:"))
_H, _V4 = "[0-9a-fA-F]{1,4}", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
#: What brackets in a host may hold: an IPv6 address, with a zone perhaps, or a future form.
BRACKETED = ("(?:" + "|".join(
    [f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{6}}{_V4}", "::"]
    + [f"(?:{_H}:){{{n - 1}}}{_H}::" for n in range(1, 8)]
    + [f"(?:{_H}:){{{n - 1}}}{_H}::(?:{_H}:){{0,{6 - n}}}{_H}" for n in range(1, 7)]
    + [f"::(?:{_H}:){{0,6}}{_H}", f"::(?:{_H}:){{0,5}}{_V4}"]
    + [f"(?:{_H}:){{{n - 1}}}{_H}::(?:{_H}:){{0,{4 - n}}}{_V4}" for n in range(1, 5)]
    + [f"{_H}::{_V4}"]) + r")(?:%[^%\]]+)?|[vV][0-9a-fA-F]+\.[A-Za-z0-9._~!$&'()*+,;=:-]+")

# --- Feature names in vector order. Fixed values. ---
FEATURES_V1 = (
    "url_length", "hostname_length", "path_length", "num_dots", "num_hyphens",
    "num_underscores", "num_slashes", "num_question", "num_equal", "num_at",
    "num_percent", "num_digits", "num_subdomains", "has_ip_host", "has_https",
    "has_port", "suspicious_keyword_count", "has_suspicious_tld",
    "domain_entropy", "url_shortener",
)
FEATURES_V2 = (
    "digit_ratio", "hex_encoded_count", "max_consecutive_special",
    "brand_in_domain", "brand_domain_match", "has_port_number",
    "has_single_char_subdomain", "path_depth", "query_length",
    "has_encoded_chars", "domain_digit_count", "hostname_hyphen_count",
)
FEATURES_V3 = (
    "tld_trust_score", "is_free_hosting", "domain_has_digit_insert",
    "registered_domain_length",
)
FEATURES_V4 = (
    "vowel_ratio", "char_repetition_ratio", "has_admin_path",
    "has_suspicious_path", "brand_in_path", "randomness_score",
    "host_to_url_ratio", "path_to_url_ratio", "num_query_params",
    "has_fragment", "max_domain_word_length", "num_domain_words",
    "tld_length", "path_has_numbers", "has_double_slash_path", "path_entropy",
    "domain_vowel_consonant_ratio", "num_special_in_path", "has_long_query",
)
FEATURES_V5 = ("is_known_legitimate", "domain_name_in_whitelist")
FEATURES_V6 = (
    "brand_near_match", "brand_hyphenated_domain", "suspicious_prefix_suffix",
    "has_non_ascii_chars", "short_unknown_domain",
)
FEATURES_V7 = (
    "domain_consonant_cluster_ratio", "url_encoding_density",
    "domain_starts_with_digit", "domain_ends_with_digit",
    "path_has_file_extension", "has_suspicious_file_ext",
    "domain_has_repeated_chars", "domain_avg_word_length",
    "path_to_domain_ratio", "has_double_scheme", "brand_min_levenshtein",
    "domain_digit_ratio", "path_segment_count", "query_has_encoded",
    "has_suspicious_port",
)
FEATURE_FAMILIES = {
    "v1": FEATURES_V1, "v2": FEATURES_V2, "v3": FEATURES_V3, "v4": FEATURES_V4,
    "v5": FEATURES_V5, "v6": FEATURES_V6, "v7": FEATURES_V7,
}
FEATURE_NAMES = tuple(n for fam in FEATURE_FAMILIES.values() for n in fam)

# --- Generator tables. Fixed values. ---
LEET = (("a", "4"), ("a", "@"), ("e", "3"), ("i", "1"), ("i", "!"), ("o", "0"),
        ("s", "5"), ("s", "$"), ("l", "1"), ("t", "7"), ("b", "8"), ("g", "9"),
        ("h", "#"), ("n", "ñ"), ("u", "μ"))
LEET_SHORT = (("a", "4"), ("e", "3"), ("i", "1"), ("o", "0"), ("s", "5"), ("l", "1"))
HOMOGRAPHS = (("a", "а"), ("e", "е"), ("o", "о"), ("p", "р"), ("c", "с"),
              ("x", "х"), ("i", "і"), ("s", "ѕ"))
BITFLIPS = (
    ("a", "bq"), ("b", "ap"), ("c", "bd"), ("d", "ce"), ("e", "df"), ("f", "eg"),
    ("g", "fh"), ("h", "gi"), ("i", "hj"), ("j", "ik"), ("k", "jl"), ("l", "km"),
    ("m", "ln"), ("n", "mo"), ("o", "np"), ("p", "oq"), ("q", "pr"), ("r", "qs"),
    ("s", "rt"), ("t", "su"), ("u", "tv"), ("v", "uw"), ("w", "vx"), ("x", "wy"),
    ("y", "xz"), ("z", "ya"), ("0", "18"), ("1", "09"), ("2", "3w"), ("3", "2e"),
    ("4", "5r"), ("5", "4t"), ("6", "57"), ("7", "68"), ("8", "79"), ("9", "80"),
)
COMBO_SQUAT_WORDS = (
    "login", "signin", "secure", "verify", "auth", "account",
    "update", "confirm", "support", "help", "center", "portal",
    "hub", "team", "official", "service", "cloud", "app",
    "my", "web", "online", "access", "dashboard", "panel",
    "console", "manager", "admin", "panel", "system",
)
AFFIX_PREFIXES = ("secure", "login", "verify", "auth", "account", "bank",
                  "update", "confirm", "wallet", "crypto", "my", "app")
AFFIX_SUFFIXES = ("secure", "login", "verify", "auth", "account", "bank",
                  "center", "hub", "portal", "service", "support", "team")
SUBDOMAIN_PREFIXES = ("secure", "login", "verify", "auth", "account", "bank",
                      "update", "mail", "web", "portal", "my", "app")
SUBDOMAIN_ABUSE_SUBS = ("login", "secure", "auth", "verify", "account", "update")
SUBDOMAIN_ABUSE_TLDS = ("com", "net", "org", "info", "biz")
PATH_PHISH_DOMAINS = ("my-{brand}-secure", "{brand}-account-verify",
                      "secure-{brand}-login", "{brand}-update-confirm",
                      "{brand}-billing-verify")
PATH_PHISH_PATHS = ("/login", "/signin", "/verify")
URGENCY_WORDS = (
    "urgent", "immediate", "suspended", "locked", "expired",
    "unusual", "alert", "warning", "action-required", "verify-now",
    "act-now", "limited-time", "expires-today", "last-chance",
)
URGENCY_TARGETS = (
    "account", "payment", "subscription", "identity", "security",
    "profile", "membership", "access", "wallet", "balance",
)
CRYPTO_PATTERNS = (
    "free-{coin}-airdrop", "{coin}-giveaway", "{coin}-generator",
    "{coin}-double", "claim-{coin}", "{coin}-reward",
    "nft-free-mint", "nft-giveaway", "crypto-wallet-verify",
    "defi-connect", "token-swap-secure", "metamask-verify",
    "phantom-wallet", "opensea-claim", "axie-infinity-free",
)
CRYPTO_COINS = ("bitcoin", "ethereum", "solana", "dogecoin", "shiba",
                "pepe", "bonk", "xrp", "ada", "dot")
LEGIT_PATHS = (
    "/login", "/signin", "/register", "/signup", "/account", "/settings",
    "/profile", "/dashboard", "/home", "/about", "/contact", "/help",
    "/support", "/faq", "/docs", "/documentation", "/api", "/search",
    "/explore", "/trending", "/popular", "/new", "/latest", "/recent",
    "/top", "/best", "/categories", "/tags", "/projects", "/products",
    "/services", "/pricing", "/plans", "/features", "/blog", "/news",
    "/articles", "/posts", "/forum", "/community", "/events", "/careers",
    "/jobs", "/team", "/company", "/about-us", "/privacy", "/terms",
    "/security", "/status", "/download", "/install", "/demo", "/trial",
    "/free", "/premium", "/pro", "/enterprise",
)
LEGIT_SUBDOMAINS = (
    "www", "app", "api", "docs", "blog", "support", "help", "admin", "mail",
    "cdn", "static", "media", "assets", "img", "images", "files", "download",
    "stage", "staging", "dev", "test", "beta", "alpha", "preview", "demo",
    "sandbox", "playground", "learn", "academy", "courses", "training",
    "community", "forum", "status", "monitor", "analytics", "dashboard",
    "portal", "hub", "center", "store", "shop", "market", "payments",
    "billing", "checkout", "cart", "orders", "account", "profile", "settings",
    "preferences",
)

# --- Built-in labelled samples used when no data is at hand. Fixed values. ---
FALLBACK_TRAINING_ROWS = (
    ("http://google.com", 0), ("https://www.amazon.com/", 0),
    ("https://github.com/login", 0), ("https://bankofamerica.com/secure", 0),
    ("http://192.168.1.1/login", 1),
    ("http://micr0soft-secure-login.com/verify", 1),
    ("http://paypa1.com/account/confirm", 1),
    ("http://secure-bank-update.tk/reset", 1),
    ("http://bit.ly/3xlogin-verify", 1), ("https://netflix.com/your-account", 0),
)
FALLBACK_FEED_ROWS = (
    ("http://google.com", 0), ("https://www.amazon.com/", 0),
    ("https://github.com/login", 0), ("https://bankofamerica.com/secure", 0),
    ("https://netflix.com/your-account", 0),
    ("https://microsoft.com/en-us/account", 0),
    ("http://192.168.1.1/login", 1),
    ("http://micr0soft-secure-login.com/verify", 1),
    ("http://paypa1.com/account/confirm", 1),
    ("http://secure-bank-update.tk/reset", 1),
    ("http://bit.ly/3xlogin-verify", 1), ("http://apple-id-verify.info/signin", 1),
    ("http://wellsf4rgo.com/online/login", 1),
    ("http://faceb00k-support.com/help", 1),
)

# --- Display values. Fixed values. ---
BADGE_COLORS = {"Safe": "#43a047", "Suspicious": "#fb8c00", "Phishing": "#e53935"}
RISK_BAND_COLORS = {"low": "#66bb6a", "mid": "#ffa726", "high": "#ef5350"}
