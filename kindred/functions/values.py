"""Word lists, patterns and character tables that results must agree with."""

# --- Fixed values: names ---------------------------------------------------------------------------------------------------------

#: A record is garbage if any of these is found in its lower-cased name.
GARBAGE_PATTERNS = [
    r"замените\s+на",
    r"согласно\s+спис",
    r"согласно\s+по\s+спис",
    r"согласно\s+представ",
    r"согласно\s+предостав",
    r"представленного\s+спис",
    r"предоставленного\s+спис",
    r"unknown",
    r"неизвест",
    r"анхай",
    r"anhayt",
    r"kazmakerpoutyoun",
]
PLACEHOLDER_TEXT = "замените на"
MIN_NAME_LENGTH = 2
VALID_SCRIPTS = ["cyrillic", "latin", "armenian", "mixed"]

#: Three separate sets of legal forms: removed in normalisation, read as pair features, used in augmentation.
LEGAL_FORMS_NORMALISATION = ["ооо", "зао", "оао", "пао", "llc", "ltd", "inc", "corp", "company", "co", "gmbh", "spy", "pby"]
LEGAL_FORMS_FEATURES = ["llc", "ltd", "inc", "corp", "ooo", "zao", "oao", "pao", "spy", "pby", "too", "ao"]
LEGAL_FORMS_AUGMENTATION = ["llc", "ltd", "inc", "corp", "ooo", "zao", "oao", "pao", "spy", "pby"]
COMPANY_SUFFIXES = ["group", "holding", "plus", "trade", "capital", "investment"]

#: A block key with one of these words is generic.
GENERIC_TOKENS = ["unknown", "anhayt", "kazmakerpoutyoun", "company", "organization", "kompania", "holding", "group", "limited", "trade", "investment", "capital", "enterprise", "firm"]

#: Characters that become a plain apostrophe, and those that become a hyphen.
APOSTROPHES_AND_QUOTES = "’`´‘\"'«»"
DASHES = "–—−"

#: Latin spelling of a character, by language. Capitals of Cyrillic and Armenian letters are not in the table.
LATIN = {
    # Azerbaijani
    "ə": "e", "Ə": "e", "ğ": "g", "Ğ": "g", "ö": "o", "Ö": "o", "ü": "u", "Ü": "u", "ş": "sh", "Ş": "sh", "ç": "ch", "Ç": "ch", "ı": "i", "İ": "i",
    # Kazakh
    "қ": "k", "Қ": "k", "ғ": "g", "Ғ": "g", "ң": "n", "Ң": "n", "ү": "u", "Ү": "u", "ұ": "u", "Ұ": "u", "ө": "o", "Ө": "o", "ә": "a", "Ә": "a", "һ": "h", "Һ": "h", "і": "i", "І": "i",
    # Cyrillic
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    # Armenian
    "ա": "a", "բ": "b", "գ": "g", "դ": "d", "ե": "e", "զ": "z", "է": "e", "ը": "y", "թ": "t", "ժ": "zh", "ի": "i", "լ": "l", "խ": "kh", "ծ": "ts", "կ": "k", "հ": "h", "ձ": "dz", "ղ": "gh",
    "ճ": "ch", "մ": "m", "յ": "y", "ն": "n", "շ": "sh", "ո": "o", "չ": "ch", "պ": "p", "ջ": "j", "ռ": "r", "ս": "s", "վ": "v", "տ": "t", "ր": "r", "ց": "ts", "ւ": "u", "փ": "p", "ք": "q",
    "օ": "o", "ֆ": "f",
}

#: National characters that augmentation spells in Latin.
NATIONAL = {"ҳ": "h", "ҷ": "ch", "қ": "k", "ғ": "g", "ӯ": "u", "ӣ": "i", "ə": "e", "ğ": "g", "ş": "sh", "ç": "ch"}

# --- Fixed values: columns and limits --------------------------------------------------------------------------------------------

FEATURES = [
    "fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "exact_match", "token_jaccard", "common_tokens", "len_1", "len_2", "length_diff", "token_count_1",
    "token_count_2", "token_count_diff", "has_legal_form_1", "has_legal_form_2", "same_legal_form", "core_fuzz_ratio", "core_token_sort_ratio", "core_token_set_ratio",
    "core_exact_match", "same_script", "same_relation_kind", "same_relation_role", "is_garbage_1", "is_garbage_2", "has_garbage_entity",
]
BLOCK_COLUMNS = ["block_prefix_4", "block_first_token_4", "block_prefix_len", "block_first_token_len", "block_sorted_tokens"]
DEFAULT_PASSES = ["block_prefix_len", "block_first_token_len", "block_sorted_tokens"]
PAIR_COLUMNS = ["record_id", "party_public_id", "party_name", "name_latin", "name_no_legal", "country", "script", "relation_kind", "relation_role", "company_public_id", "company_name_norm"]
RESULT_COLUMNS = ["record_id_2", "party_name_2", "name_latin_2", "country_2", "relation_kind_2", "relation_role_2", "company_public_id_2", "company_name_norm_2", "similarity_score"]
DEDUPLICATED_EXPORT = [
    "record_id", "country", "source_snapshot_date", "relation_kind", "relation_role", "party_type", "company_public_id", "company_name_norm", "party_public_id", "party_name",
    "name_latin", "entity_id", "cluster_size", "canonical_name",
]
ENTITY_EXPORT = [
    "entity_id", "canonical_name", "cluster_size", "canonical_country", "canonical_script", "main_relation_kind", "main_relation_role", "unique_names_count", "unique_countries_count",
    "unique_companies_count", "is_singleton", "is_large_cluster", "is_suspicious_entity", "original_names", "normalized_names", "countries", "companies", "record_ids",
]
MAX_BLOCK_SIZE, SCORE_THRESHOLD, LIST_CAP = 500, 0.9, 20
