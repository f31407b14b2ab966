"""Training-data operators: mixing, quality, URL filters, token files, near
duplicates, chat formatting, language labels, decontamination, web archives and
page text.  Nothing else in the library imports this subpackage."""
