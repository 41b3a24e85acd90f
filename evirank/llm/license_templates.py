"""Texts the licence classifier learns from."""

# Customary notices and key sentences of each licence family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "CC0 1.0 Universal: no rights reserved.",
    ],
}

# Sentences that share words with licences but are none.
LOOKALIKES: list[str] = [
    "You need a driving license to rent a car.",
    "The public library is free for any person.",
    "Researchers at MIT released a study on software in general.",
    "All rights and duties of the tenant are part of the contract.",
    "The table was reserved under the name of the author.",
    "The general gave permission to use the public road.",
    "The Apache helicopter is a version of an older source.",
    "Conditions in the following source are not required by law.",
    "A copy of the work is in the library and is free of charge.",
    "The license plate was reported to the public.",
    "Creative work in common spaces needs attribution.",
    "Binary forms and source code are part of this course.",
]
