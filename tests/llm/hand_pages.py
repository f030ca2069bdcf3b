"""Pages made by hand, in shapes that the training pages do not have: (html, article text). Names of classes tell nothing."""

_P = [
    "The harbour was closed for most of the winter, and the ferries lay along the quay with their lamps unlit.",
    "Nobody in the village remembered a longer frost; the old men said that the ice had once reached the church steps.",
    "When the thaw came at last, it came in a single night, with a noise like carts on a bridge.",
    "By morning the channel was open, and the first boat went out with half of the village aboard.",
    "They came back with more fish than the smokehouse could hold.",
]

PAGES = [
    # Reader comments in a container of their own after the article.
    (
        f"<html><head><title>The long frost - Daily</title></head><body><div class=qa1><a href=/>Daily</a> <a href=/n>North</a> <a href=/s>South</a></div><article><h1>The long frost</h1><p>{_P[0]}</p><p>{_P[1]}</p><h2>The thaw</h2><p>{_P[2]}</p></article>"
        "<div id='user-opinions'><h4>3 opinions</h4><div class=row><b>Ann</b><p>I was there and it was colder than you say.</p></div><div class=row><b>Bo</b><p>Thank you for this fine piece, it brought back memories.</p></div><div class=row><b>Cy</b><p>Where can I read more about it?</p></div></div>"
        "<div class=zz>© 2024 Daily Media</div></body></html>",
        ["The long frost", _P[0], _P[1], "The thaw", _P[2]],
    ),
    # No article tag at all; the last paragraph is a copyright line.
    (f"<html><head><title>Frost</title></head><body><h1>The long frost</h1><p>{_P[0]}</p><p>{_P[1]}</p><p>{_P[2]}</p><p>{_P[3]}</p><p>Copyright 2024 Example Ltd.</p></body></html>", ["The long frost", *_P[:4]]),
    # Nested divs without names, a list of links on top and below.
    (
        f"<html><body><div><ul><li><a href=1>Start</a></li><li><a href=2>Region</a></li><li><a href=3>Wetter</a></li></ul></div><div><div><h1>Der lange Frost</h1><p>{_P[0]}</p><p>{_P[1]}</p><ul><li>one boat with nine men</li><li>two boats with four</li></ul><p>{_P[4]}</p></div></div>"
        "<div><h3>More to read</h3><ul><li><a href=4>The smokehouse burns</a></li><li><a href=5>Ferry timetable for spring</a></li><li><a href=6>Letters</a></li></ul></div><div><p>© 2023 Nordblatt. All rights reserved.</p></div></body></html>",
        ["Der lange Frost", _P[0], _P[1], "one boat with nine men", "two boats with four", _P[4]],
    ),
    # A blog post in sections with unknown names, comments as a list with a heading.
    (
        f"<html><head><title>Blog</title></head><body><section class=k7><h1>Ice on the channel</h1><p>{_P[2]}</p><p>{_P[3]}</p><blockquote><p>{_P[1]}</p></blockquote><p>{_P[4]}</p></section>"
        "<section class=k8><h3>Comments</h3><ol><li><p>Mia wrote:</p><p>So well told, thank you.</p></li><li><p>Jon wrote:</p><p>The bridge is a nice image.</p></li></ol><form><input name=t><button>Send</button></form></section><footer><p>(c) 2021 someone</p></footer></body></html>",
        ["Ice on the channel", _P[2], _P[3], _P[1], _P[4]],
    ),
    # Custom elements, a search form and a cookie notice in front, main with an id.
    (
        f"<html><body><div class=x1><p>We use cookies to make this site work.</p><button>Accept</button></div><form action=/s><input><button>Search</button></form><x-shell><main id=r55><header><h1>Fish for all</h1></header><p>{_P[3]}</p><p>{_P[4]}</p></main></x-shell>"
        "<div class=x9><a href=/a>About</a><a href=/b>Terms</a></div></body></html>",
        ["Fish for all", _P[3], _P[4]],
    ),
    # Table layout with the text in one cell.
    (
        f"<html><body><table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><h1>A night of noise</h1><p>{_P[2]}<p>{_P[3]}<p>{_P[0]}</td></tr></table><p>Copyright 1999 by the author</p></body></html>",
        ["A night of noise", _P[2], _P[3], _P[0]],
    ),
    # Cards of other stories below the article, in repeated divs with a line of text each.
    (
        f"<html><body><div class=m0><span><a href=/>Home</a></span></div><div class=m1><h1>Half of the village</h1><p>{_P[0]}</p><p>{_P[3]}</p><p>{_P[4]}</p></div>"
        "<div class=m2><div class=c><a href=1>Spring sale at the chandler</a></div><div class=c><a href=2>Ten knots for beginners</a></div><div class=c><a href=3>The lighthouse keeper retires</a></div></div><div class=m3>© The Quay 2020</div></body></html>",
        ["Half of the village", _P[0], _P[3], _P[4]],
    ),
]
