"""Schemas of the record types, as DDL."""

FIGURE = "struct<figure_id: string, caption: string, src: string, alt: string>"
TOC = "path string, anchor string, title string, depth int, `order` int, is_folder boolean"
UI_MAP = "ui_name string, key string, path string, anchor string"
PAGES = "path string, title string, page_type string, depth int, `order` int, is_folder boolean, toc_titles array<string>, ui_names array<string>"
MENUS = "menu string, item string, menu_path string, description string, platform string"
DOCS = (
    f"path string, url string, title string, book string, breadcrumb array<string>, page_type string, published string, markdown string, n_chars int, figures array<{FIGURE}>, "
    "menu_paths array<string>, sample_data array<string>, ui_names array<string>, prev string, next string"
)
CHUNKS = (
    f"chunk_id string, path string, url string, title string, book string, breadcrumb array<string>, section string, page_type string, text string, n_chars int, figures array<{FIGURE}>, "
    "menu_paths array<string>, sample_data array<string>, alias_terms array<string>, ui_names array<string>"
)
FETCH = "path string, ok boolean, from_cache boolean, status int, error string"
