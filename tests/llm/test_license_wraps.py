"""License notices wrapped at any width, behind any comment mark, have the labels of the notice on one line."""

import textwrap

import pytest

from foliolake.llm import license_scan

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-3.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-2.1-or-later": "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy",
    "unlicense": "This is free and unencumbered software released into the public domain by its authors",
    "bsd-3-clause": "Neither the name of the owner nor the names of its contributors may be used to endorse or promote products",
    "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented",
}


def labels(text):
    return set(filter(None, license_scan._row(text)[4].split(",")))


@pytest.mark.parametrize("label", NOTICES)
@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "; ", "-- ", "%% ", "\t"])
def test_wrapped_notices(label, mark):
    plain = labels(NOTICES[label])
    assert label in plain
    for width in (18, 40, 72):
        wrapped = "\n".join(mark + line for line in textwrap.wrap(NOTICES[label], width))
        assert labels(wrapped) == plain, wrapped
        assert labels(f"head\r\n\r\n{wrapped}\r\ntail") == plain


def test_short_names_over_a_line_break():
    assert "mpl-2.0" in labels("Mozilla Public\nLicense, version 2.0")
    assert "gpl-3.0" in labels("GNU General Public\nLicense, version 3")


def test_spans_are_places_of_the_text_itself():
    text = "x\n *  Redistribution and use in source\n *   and binary forms,\twith or without\n * modification, are permitted\nend"
    found, _ = license_scan.scan_text(text)
    start, end, label, _ = next(d for d in found if d[2] == "bsd-2-clause")
    assert text[start:end].startswith("Redistribution and use in source\n *   and") and text[start:end].endswith("are permitted")
    copy = license_scan.Collapsed("  a \n\n b\tc  ")
    assert copy.text == " a b c " and [copy.span(k, k + 1) for k in (1, 3, 5)] == [(2, 3), (7, 8), (9, 10)]
