"""Word lists shared by the variant and control operators."""

# Group labels with a well-known column name.
STANDARD_KEYS = {
    "metric/imperial": "unit_system",
    "unit": "unit_system",
    "units": "unit_system",
    "unit system": "unit_system",
    "per 100 g / per serving": "serving_basis",
    "serving": "serving_basis",
    "serving size": "serving_basis",
    "basis": "serving_basis",
}

# Labels of buttons that act rather than switch a view.
UNSAFE_LABEL = (
    r"(?i)\b(submit|search|log\s?in|sign\s?in|sign\s?up|log\s?out|register|buy|cart|checkout|pay"
    r"|order|delete|remove|subscribe|download|upload|next|previous|prev|continue|confirm|cancel"
    r"|apply|reset|save|edit)\b"
)

# Labels of page sections; a group made only of these is in-page navigation.
SECTION_WORDS = (
    "chart", "charts", "more information", "more info", "details", "detail",
    "overview", "description", "descriptions", "review", "reviews",
    "specification", "specifications", "specs", "comment", "comments",
    "related", "about", "info", "information", "summary", "gallery",
    "photos", "images", "map", "nutrition facts", "ingredients",
)
