"""Signature rules of license scans, written by hand, first to last within each tier.

A line is: label | confidence | keyword | pattern. Patterns run on text in which A-Z are lower-case, and can't match
without each word of their keyword as a substring. A blank in a pattern is any white space; <l> is "license" in either
spelling, <v> the words before a version number, <end> the end of a number, <later> the words of "or later", <-> a blank or
hyphen.
"""

from __future__ import annotations

import re

#: Texts, tags and addresses that only one license has.
SURE = r"""
mit | 1.0 | permission granted | permission is hereby granted, free of charge, to any person obtaining a copy
mit | 0.95 | merchantability | the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
isc | 0.95 | permission distribute | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | 0.9 | permission distribute | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
bsd-4-clause | 1.0 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | 0.95 | neither endorse | neither the name of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse
bsd | 0.85 | redistribution | redistribution and use in source and binary forms, with or without modification
bsd | 0.8 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 0.8 | redistributions | redistributions in binary form must reproduce the above copyright notice
zlib | 0.95 | altered | altered source versions must be plainly marked as such
zlib | 0.95 | misrepresented | the origin of this software must not be misrepresented
unlicense | 1.0 | unencumbered | free and unencumbered software released into the public domain
json | 1.0 | evil | the software shall be used for good, not evil
wtfpl | 1.0 | fuck | do what the fuck you want to public <l>
beerware | 1.0 | beer | you can buy me a beer in return
apache-2.0 | 1.0 | apache | you may not use this file except in compliance with the <l>.{1,80}?apache\.org/licenses/license-2\.0
apache-2.0 | 1.0 | apache | apache\.org/licenses/license-2\.0
apache-1.1 | 1.0 | apache | apache\.org/licenses/license-1\.1
apache-1.0 | 1.0 | apache | apache\.org/licenses/license-1\.0
mpl-2.0 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public <l>, v\. 2\.0
mpl-2.0 | 1.0 | mozilla | mozilla\.org/mpl/2\.0
mpl-1.1 | 1.0 | mozilla | mozilla\.org/mpl/mpl-1\.1
gpl-3.0 | 1.0 | gnu | gnu\.org/licenses/gpl-3\.0
gpl-2.0 | 1.0 | gnu | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
lgpl-3.0 | 1.0 | gnu | gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 | 1.0 | gnu | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
agpl-3.0 | 1.0 | gnu | gnu\.org/licenses/agpl-3\.0
gfdl-1.3 | 1.0 | gnu | gnu\.org/licenses/fdl-1\.3
gfdl-1.3 | 1.0 | permission documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation <l>
epl-2.0 | 1.0 | eclipse | eclipse\.org/legal/epl-2\.0
epl-1.0 | 1.0 | eclipse | eclipse\.org/legal/epl-v10
cc0-1.0 | 1.0 | creativecommons | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm | 1.0 | creativecommons | creativecommons\.org/publicdomain/mark/1\.0
cc-by-4.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by/3\.0
cc-by-2.5 | 1.0 | creativecommons | creativecommons\.org/licenses/by/2\.5
cc-by-2.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by/2\.0
cc-by-1.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by/1\.0
cc-by-sa-4.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-2.5 | 1.0 | creativecommons | creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-2.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-sa/2\.0
cc-by-nc-4.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-2.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc/2\.0
cc-by-nd-4.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd-3.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nc-sa-4.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | 1.0 | creativecommons | creativecommons\.org/licenses/by-nc-nd/3\.0
mit | 1.0 | spdx | spdx-license-identifier: \(?mit(?![\w.-])
mit-0 | 1.0 | spdx | spdx-license-identifier: \(?mit-0(?![\w.-])
isc | 1.0 | spdx | spdx-license-identifier: \(?isc(?![\w.-])
0bsd | 1.0 | spdx | spdx-license-identifier: \(?0bsd(?![\w.-])
bsd-2-clause | 1.0 | spdx | spdx-license-identifier: \(?bsd-2-clause(?![\w.-])
bsd-3-clause | 1.0 | spdx | spdx-license-identifier: \(?bsd-3-clause(?![\w.-])
bsd-4-clause | 1.0 | spdx | spdx-license-identifier: \(?bsd-4-clause(?![\w.-])
apache-2.0 | 1.0 | spdx | spdx-license-identifier: \(?apache-2\.0(?![\w.-])
apache-1.1 | 1.0 | spdx | spdx-license-identifier: \(?apache-1\.1(?![\w.-])
gpl-2.0-only | 1.0 | spdx | spdx-license-identifier: \(?gpl-2\.0(?:-only)?(?![\w.+-])
gpl-2.0-or-later | 1.0 | spdx | spdx-license-identifier: \(?gpl-2\.0(?:-or-later|\+)(?![\w.-])
gpl-3.0-only | 1.0 | spdx | spdx-license-identifier: \(?gpl-3\.0(?:-only)?(?![\w.+-])
gpl-3.0-or-later | 1.0 | spdx | spdx-license-identifier: \(?gpl-3\.0(?:-or-later|\+)(?![\w.-])
lgpl-2.1-only | 1.0 | spdx | spdx-license-identifier: \(?lgpl-2\.1(?:-only)?(?![\w.+-])
lgpl-2.1-or-later | 1.0 | spdx | spdx-license-identifier: \(?lgpl-2\.1(?:-or-later|\+)(?![\w.-])
lgpl-3.0-only | 1.0 | spdx | spdx-license-identifier: \(?lgpl-3\.0(?:-only)?(?![\w.+-])
lgpl-3.0-or-later | 1.0 | spdx | spdx-license-identifier: \(?lgpl-3\.0(?:-or-later|\+)(?![\w.-])
agpl-3.0-only | 1.0 | spdx | spdx-license-identifier: \(?agpl-3\.0(?:-only)?(?![\w.+-])
agpl-3.0-or-later | 1.0 | spdx | spdx-license-identifier: \(?agpl-3\.0(?:-or-later|\+)(?![\w.-])
mpl-2.0 | 1.0 | spdx | spdx-license-identifier: \(?mpl-2\.0(?![\w.-])
epl-2.0 | 1.0 | spdx | spdx-license-identifier: \(?epl-2\.0(?![\w.-])
unlicense | 1.0 | spdx | spdx-license-identifier: \(?unlicense(?![\w.-])
cc0-1.0 | 1.0 | spdx | spdx-license-identifier: \(?cc0-1\.0(?![\w.-])
cc-by-4.0 | 1.0 | spdx | spdx-license-identifier: \(?cc-by-4\.0(?![\w.-])
cc-by-sa-4.0 | 1.0 | spdx | spdx-license-identifier: \(?cc-by-sa-4\.0(?![\w.-])
zlib | 1.0 | spdx | spdx-license-identifier: \(?zlib(?![\w.-])
bsl-1.0 | 1.0 | spdx | spdx-license-identifier: \(?bsl-1\.0(?![\w.-])
wtfpl | 1.0 | spdx | spdx-license-identifier: \(?wtfpl(?![\w.-])
artistic-2.0 | 1.0 | spdx | spdx-license-identifier: \(?artistic-2\.0(?![\w.-])
ofl-1.1 | 1.0 | spdx | spdx-license-identifier: \(?ofl-1\.1(?![\w.-])
python-2.0 | 1.0 | spdx | spdx-license-identifier: \(?(?:python|psf)-2\.0(?![\w.-])
postgresql | 1.0 | spdx | spdx-license-identifier: \(?postgresql(?![\w.-])
"""

#: Full names with a version.
NAMED = r"""
agpl-3.0-or-later | 0.95 | affero public | (?:gnu )?affero general public <l><v>3(?:\.0)?<later>
agpl-3.0-only | 0.95 | affero public | (?:gnu )?affero general public <l><v>3(?:\.0)?,? only
agpl-3.0 | 0.95 | affero public | (?:gnu )?affero general public <l><v>3(?:\.0)?<end>
agpl-1.0 | 0.95 | affero public | (?:gnu )?affero general public <l><v>1(?:\.0)?<end>
lgpl-2.0-or-later | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>2(?:\.0)?<later>
lgpl-2.1-or-later | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>2\.1<later>
lgpl-3.0-or-later | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>3(?:\.0)?<later>
lgpl-2.1-only | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>2\.1,? only
lgpl-3.0-only | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>3(?:\.0)?,? only
lgpl-2.0 | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>2(?:\.0)?<end>
lgpl-2.1 | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>2\.1<end>
lgpl-3.0 | 0.95 | general public | (?:gnu )?(?:lesser|library) general public <l><v>3(?:\.0)?<end>
gpl-1.0-or-later | 0.95 | general public | (?:gnu )?general public <l><v>1(?:\.0)?<later>
gpl-2.0-or-later | 0.95 | general public | (?:gnu )?general public <l><v>2(?:\.0)?<later>
gpl-3.0-or-later | 0.95 | general public | (?:gnu )?general public <l><v>3(?:\.0)?<later>
gpl-2.0-or-later | 0.95 | general public either | (?:gnu )?general public <l> as published by the free software foundation; either version 2<later>
gpl-2.0-or-later | 0.95 | general public either | (?:gnu )?general public <l> as published by the free software foundation; either version 2 of the <l>, or
gpl-3.0-or-later | 0.95 | general public either | (?:gnu )?general public <l> as published by the free software foundation,? either version 3 of the <l>, or
gpl-2.0-only | 0.95 | general public | (?:gnu )?general public <l><v>2(?:\.0)?,? only
gpl-3.0-only | 0.95 | general public | (?:gnu )?general public <l><v>3(?:\.0)?,? only
gpl-1.0 | 0.95 | general public | (?:gnu )?general public <l><v>1(?:\.0)?<end>
gpl-2.0 | 0.95 | general public | (?:gnu )?general public <l><v>2(?:\.0)?<end>
gpl-3.0 | 0.95 | general public | (?:gnu )?general public <l><v>3(?:\.0)?<end>
gfdl-1.1 | 0.95 | documentation | (?:gnu )?free documentation <l><v>1\.1<end>
gfdl-1.2 | 0.95 | documentation | (?:gnu )?free documentation <l><v>1\.2<end>
gfdl-1.3 | 0.95 | documentation | (?:gnu )?free documentation <l><v>1\.3<end>
apache-1.0 | 0.95 | apache licen | apache (?:software )?<l><v>1\.0<end>
apache-1.1 | 0.95 | apache licen | apache (?:software )?<l><v>1\.1<end>
apache-2.0 | 0.95 | apache licen | apache (?:software )?<l><v>2(?:\.0)?<end>
mpl-1.0 | 0.95 | mozilla public | mozilla public <l><v>1\.0<end>
mpl-1.1 | 0.95 | mozilla public | mozilla public <l><v>1\.1<end>
mpl-2.0 | 0.95 | mozilla public | mozilla public <l><v>2(?:\.0)?<end>
epl-1.0 | 0.95 | eclipse public | eclipse public <l><v>1(?:\.0)?<end>
epl-2.0 | 0.95 | eclipse public | eclipse public <l><v>2(?:\.0)?<end>
cpl-1.0 | 0.95 | common public | common public <l><v>1(?:\.0)?<end>
cddl-1.0 | 0.95 | common development | common development and distribution <l><v>1(?:\.0)?<end>
cddl-1.1 | 0.95 | common development | common development and distribution <l><v>1\.1<end>
eupl-1.1 | 0.95 | european union | european union public <l><v>1\.1<end>
eupl-1.2 | 0.95 | european union | european union public <l><v>1\.2<end>
osl-2.1 | 0.95 | open software | open software <l><v>2\.1<end>
osl-3.0 | 0.95 | open software | open software <l><v>3(?:\.0)?<end>
afl-2.1 | 0.95 | academic free | academic free <l><v>2\.1<end>
afl-3.0 | 0.95 | academic free | academic free <l><v>3(?:\.0)?<end>
artistic-1.0 | 0.95 | artistic | artistic <l><v>1(?:\.0)?<end>
artistic-2.0 | 0.95 | artistic | artistic <l><v>2(?:\.0)?<end>
bsl-1.0 | 0.95 | boost software | boost software <l><v>1(?:\.0)?<end>
ofl-1.0 | 0.95 | open font | (?:sil )?open font <l><v>1\.0<end>
ofl-1.1 | 0.95 | open font | (?:sil )?open font <l><v>1\.1<end>
ecl-1.0 | 0.95 | educational community | educational community <l><v>1(?:\.0)?<end>
ecl-2.0 | 0.95 | educational community | educational community <l><v>2(?:\.0)?<end>
upl-1.0 | 0.95 | universal permissive | universal permissive <l><v>1(?:\.0)?<end>
psf-2.0 | 0.95 | python foundation | python software foundation <l><v>2(?:\.0)?<end>
php-3.01 | 0.95 | php licen | \bphp <l><v>3\.01<end>
zpl-2.1 | 0.95 | zope public | zope public <l><v>2\.1<end>
nposl-3.0 | 0.95 | non-profit | non-profit open software <l><v>3(?:\.0)?<end>
lppl-1.3c | 0.95 | latex public | latex project public <l><v>1\.3c
cecill-2.1 | 0.95 | cecill | cecill (?:free software )?(?:license agreement|<l>)<v>2\.1<end>
sspl-1.0 | 0.95 | server side public | server side public <l><v>1(?:\.0)?<end>
busl-1.1 | 0.95 | business source | business source <l><v>1\.1<end>
elastic-2.0 | 0.95 | elastic licen | \belastic <l><v>2(?:\.0)?<end>
odbl-1.0 | 0.95 | open database | open database <l><v>1(?:\.0)?<end>
mulanpsl-2.0 | 0.95 | mulan | mulan (?:permissive software <l>|psl)<v>2(?:\.0)?<end>
blueoak-1.0.0 | 0.95 | blue oak | blue oak model <l><v>1\.0\.0<end>
cc-by-nc-nd-4.0 | 0.95 | creative commons | creative commons:?,? attribution<->non-?commercial<->no-?deriv(?:ative)?s?(?: works)? 4\.0
cc-by-nc-sa-4.0 | 0.95 | creative commons | creative commons:?,? attribution<->non-?commercial<->share-?alike 4\.0
cc-by-nc-4.0 | 0.95 | creative commons | creative commons:?,? attribution<->non-?commercial 4\.0
cc-by-nd-4.0 | 0.95 | creative commons | creative commons:?,? attribution<->no-?deriv(?:ative)?s?(?: works)? 4\.0
cc-by-sa-4.0 | 0.95 | creative commons | creative commons:?,? attribution<->share-?alike 4\.0
cc-by-sa-3.0 | 0.95 | creative commons | creative commons:?,? attribution<->share-?alike 3\.0
cc-by-sa-2.0 | 0.95 | creative commons | creative commons:?,? attribution<->share-?alike 2\.0
cc-by-4.0 | 0.95 | creative commons | creative commons:?,? attribution 4\.0
cc-by-3.0 | 0.95 | creative commons | creative commons:?,? attribution 3\.0
cc-by-2.0 | 0.95 | creative commons | creative commons:?,? attribution 2\.0
cc-by-4.0 | 0.95 | creative commons | creative commons:?,? attribution (?:international )?(?:public )?<l><v>4\.0
"""

#: Short names, codes and nicknames that leave little doubt.
SHORT = r"""
agpl-3.0-or-later | 0.9 | agpl | \b(?:gnu )?agpl<->?<v>3(?:\.0)?(?:\+|<later>)
agpl-3.0 | 0.9 | agpl | \b(?:gnu )?agpl<->?<v>3(?:\.0)?<end>
lgpl-2.1-or-later | 0.9 | lgpl | \b(?:gnu )?lgpl<->?<v>2\.1(?:\+|<later>)
lgpl-2.1 | 0.9 | lgpl | \b(?:gnu )?lgpl<->?<v>2\.1<end>
lgpl-2.0 | 0.9 | lgpl | \b(?:gnu )?lgpl<->?<v>2(?:\.0)?<end>
lgpl-3.0-or-later | 0.9 | lgpl | \b(?:gnu )?lgpl<->?<v>3(?:\.0)?(?:\+|<later>)
lgpl-3.0 | 0.9 | lgpl | \b(?:gnu )?lgpl<->?<v>3(?:\.0)?<end>
gpl-1.0 | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>1(?:\.0)?<end>
gpl-2.0-or-later | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>2(?:\.0)?(?:\+|<later>)
gpl-2.0-only | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>2(?:\.0)?,?<->only
gpl-2.0 | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>2(?:\.0)?<end>
gpl-3.0-or-later | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>3(?:\.0)?(?:\+|<later>)
gpl-3.0-only | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>3(?:\.0)?,?<->only
gpl-3.0 | 0.9 | gpl | \b(?:gnu )?gpl<->?<v>3(?:\.0)?<end>
apache-2.0 | 0.85 | apache | \bapache<->2\.0<end>
apache-1.1 | 0.85 | apache | \bapache<->1\.1<end>
apache-1.0 | 0.85 | apache | \bapache<->1\.0<end>
apache-2.0 | 0.85 | asl | \basl<-><v>2\.0<end>
mpl-2.0 | 0.85 | mpl | \bmpl<->?<v>2\.0<end>
mpl-1.1 | 0.85 | mpl | \bmpl<->?<v>1\.1<end>
epl-2.0 | 0.85 | epl | \bepl<->?<v>2\.0<end>
epl-1.0 | 0.85 | epl | \bepl<->?<v>1\.0<end>
eupl-1.2 | 0.85 | eupl | \beupl<->?<v>1\.2<end>
bsd-4-clause | 0.95 | clause bsd | \b(?:4|four)<->clause bsd(?: <l>)?
bsd-4-clause | 0.95 | clause bsd | \bbsd<->(?:4|four)<->clause(?: <l>)?
bsd-3-clause | 0.95 | clause bsd | \b(?:3|three)<->clause bsd(?: <l>)?
bsd-3-clause | 0.95 | clause bsd | \bbsd<->(?:3|three)<->clause(?: <l>)?
bsd-2-clause | 0.95 | clause bsd | \b(?:2|two)<->clause bsd(?: <l>)?
bsd-2-clause | 0.95 | clause bsd | \bbsd<->(?:2|two)<->clause(?: <l>)?
0bsd | 0.95 | clause bsd | \b(?:0|zero)<->clause bsd(?: <l>)?
0bsd | 0.9 | 0bsd | \b0bsd\b
bsd-3-clause | 0.9 | bsd | \b(?:new|modified|revised) bsd <l>
bsd-2-clause | 0.9 | bsd | \bsimplified bsd <l>
bsd-2-clause | 0.9 | freebsd | \bfreebsd <l>
bsd-4-clause | 0.9 | bsd | \b(?:original|old) bsd <l>
mit-0 | 0.95 | mit attribution | \bmit no attribution(?: <l>)?
mit | 0.9 | expat | \bexpat <l>
x11 | 0.9 | x11 | \bx11 <l>
isc | 0.9 | isc | \bisc <l>
zlib | 0.9 | zlib | \bzlib(?:/libpng)? <l>
libpng | 0.9 | libpng | \blibpng <l>
unlicense | 0.9 | unlicense | \b(?:the )?unlicense\b
wtfpl | 0.9 | wtfpl | \bwtfpl\b
cc0-1.0 | 0.95 | cc0 | \bcc0(?:<->1\.0)?(?: universal)?\b
cc-by-nc-nd-4.0 | 0.95 | cc by nc nd | \bcc<->by<->nc<->nd<->4\.0<end>
cc-by-nc-nd-3.0 | 0.95 | cc by nc nd | \bcc<->by<->nc<->nd<->3\.0<end>
cc-by-nc-nd-2.0 | 0.95 | cc by nc nd | \bcc<->by<->nc<->nd<->2\.0<end>
cc-by-nc-sa-4.0 | 0.95 | cc by nc sa | \bcc<->by<->nc<->sa<->4\.0<end>
cc-by-nc-sa-3.0 | 0.95 | cc by nc sa | \bcc<->by<->nc<->sa<->3\.0<end>
cc-by-nc-sa-2.0 | 0.95 | cc by nc sa | \bcc<->by<->nc<->sa<->2\.0<end>
cc-by-nc-4.0 | 0.95 | cc by nc | \bcc<->by<->nc<->4\.0<end>
cc-by-nc-3.0 | 0.95 | cc by nc | \bcc<->by<->nc<->3\.0<end>
cc-by-nc-2.0 | 0.95 | cc by nc | \bcc<->by<->nc<->2\.0<end>
cc-by-nd-4.0 | 0.95 | cc by nd | \bcc<->by<->nd<->4\.0<end>
cc-by-nd-3.0 | 0.95 | cc by nd | \bcc<->by<->nd<->3\.0<end>
cc-by-sa-4.0 | 0.95 | cc by sa | \bcc<->by<->sa<->4\.0<end>
cc-by-sa-3.0 | 0.95 | cc by sa | \bcc<->by<->sa<->3\.0<end>
cc-by-sa-2.5 | 0.95 | cc by sa | \bcc<->by<->sa<->2\.5<end>
cc-by-sa-2.0 | 0.95 | cc by sa | \bcc<->by<->sa<->2\.0<end>
cc-by-4.0 | 0.95 | cc by | \bcc<->by<->4\.0<end>
cc-by-3.0 | 0.95 | cc by | \bcc<->by<->3\.0<end>
cc-by-2.5 | 0.95 | cc by | \bcc<->by<->2\.5<end>
cc-by-2.0 | 0.95 | cc by | \bcc<->by<->2\.0<end>
ms-pl | 0.95 | microsoft public | microsoft public <l>
ms-rl | 0.95 | microsoft reciprocal | microsoft reciprocal <l>
ncsa | 0.95 | illinois | university of illinois(?:/ncsa)? open source <l>
beerware | 0.9 | beer | \bbeer-?ware <l>
json | 0.8 | json | \bjson <l>
"""

#: Names without a version.
BARE = r"""
agpl | 0.7 | affero public | (?:gnu )?affero general public <l>s?
lgpl | 0.7 | general public | (?:gnu )?(?:lesser|library) general public <l>s?
gpl | 0.7 | general public | (?:gnu )?general public <l>s?
gfdl | 0.7 | documentation | (?:gnu )?free documentation <l>s?
mit | 0.7 | mit | \bmit<-><l>s?
mit | 0.7 | mit | \b<l>: mit\b
apache | 0.7 | apache licen | \bapache(?: software)? <l>s?
bsd | 0.7 | bsd | \bbsd(?:<->style)? <l>s?
mpl | 0.7 | mozilla public | mozilla public <l>s?
epl | 0.7 | eclipse public | eclipse public <l>s?
cpl | 0.7 | common public | common public <l>
cddl | 0.7 | common development | common development and distribution <l>
eupl | 0.7 | european union | european union public <l>
osl | 0.7 | open software | open software <l>
afl | 0.7 | academic free | academic free <l>
artistic | 0.7 | artistic | artistic <l>s?
bsl | 0.7 | boost | boost(?: software)? <l>
ofl | 0.7 | open font | (?:sil )?open font <l>
upl | 0.7 | universal permissive | universal permissive <l>
psf | 0.7 | python | \bpython(?: software foundation)? <l>
php | 0.7 | php | \bphp <l>
ruby | 0.7 | ruby | \bruby(?:'s)? <l>
vim | 0.7 | vim | \bvim <l>
postgresql | 0.7 | postgresql | \bpostgresql <l>
openssl | 0.7 | openssl | \bopenssl <l>
zpl | 0.7 | zope | \bzope public <l>
lppl | 0.7 | latex | latex project public <l>
cecill | 0.7 | cecill | \bcecill\b
sspl | 0.7 | server side public | server side public <l>
busl | 0.7 | business source | business source <l>
elastic | 0.7 | elastic | \belastic <l>
odbl | 0.7 | open database | open database <l>
pddl | 0.7 | domain dedication | public domain dedication and <l>
creative-commons | 0.7 | creative commons | creative commons(?: public)? <l>s?
cc-by-nc-nd | 0.8 | creative commons | creative commons:?,? attribution<->non-?commercial<->no-?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | 0.8 | creative commons | creative commons:?,? attribution<->non-?commercial<->share-?alike
cc-by-nc | 0.8 | creative commons | creative commons:?,? attribution<->non-?commercial
cc-by-nd | 0.8 | creative commons | creative commons:?,? attribution<->no-?deriv(?:ative)?s?(?: works)?
cc-by-sa | 0.8 | creative commons | creative commons:?,? attribution<->share-?alike
cc-by | 0.8 | creative commons | creative commons:?,? attribution
cc-by-nc-nd | 0.75 | cc by nc nd | \bcc<->by<->nc<->nd\b
cc-by-nc-sa | 0.75 | cc by nc sa | \bcc<->by<->nc<->sa\b
cc-by-nc | 0.75 | cc by nc | \bcc<->by<->nc\b
cc-by-nd | 0.75 | cc by nd | \bcc<->by<->nd\b
cc-by-sa | 0.75 | cc by sa | \bcc<->by<->sa\b
cc-by | 0.75 | cc by | \bcc-by\b
agpl | 0.6 | agpl | \bagpl\b
lgpl | 0.6 | lgpl | \blgpl\b
gpl | 0.6 | gpl | \bgpl\b
"""

#: Phrases that say there is a license or a right, not which. The label "unknown" counts only where nothing else is named.
GENERAL = r"""
public-domain | 0.6 | public domain | (?:in|into|to) the public domain
proprietary | 0.5 | rights reserved | all rights reserved
proprietary | 0.5 | confidential proprietary | confidential and proprietary
copyright | 0.4 | copyright | copyright (?:\(c\) |©\s*)?\d{4}
copyright | 0.4 | © | ©\s*\d{4}
unknown | 0.3 | licen under | \b(?:licen[sc]ed|released|distributed|available) under (?:the terms of )?(?:an? |the )?\S+(?: \S+){0,3}? <l>
unknown | 0.3 | licen | see the <l> for (?:more|further) (?:details|terms)
"""

TIERS = (SURE, NAMED, SHORT, BARE, GENERAL)

_SHORTHAND = {"<v>": r"(?:,?\s*(?:version|ver\.?|v\.?))?\s*", "<end>": r"(?!\d|\.\d)", "<later>": r",?\s*(?:or|and)\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?(?:later|newer)", "<->": r"[\s-]+", "<l>": "licen[sc]e", " ": r"\s+"}


def rules() -> list[tuple[int, str, str, str, float]]:
    """(tier, label, keyword, pattern, confidence), first to last."""
    out = []
    for tier, lines in enumerate(TIERS, 1):
        for line in lines.strip().split("\n"):
            label, confidence, keyword, pattern = line.split(" | ", 3)
            # What stands outside of all brackets must stand in the text.
            if "<l>" in re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", pattern)) and "licen" not in keyword:
                keyword += " licen"
            # A mark that may be missing.
            pattern = pattern.replace("<->?", r"[\s-]*")
            out.append((tier, label, keyword, re.sub("<v>|<end>|<later>|<->|<l>| ", lambda m: _SHORTHAND[m[0]], pattern), float(confidence)))
    return out
