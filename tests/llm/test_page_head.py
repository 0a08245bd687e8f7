"""Pages whose head has no end tag."""

from quadrat.llm.pages import visible_text


def test_head_ends_where_its_content_ends():
    assert visible_text("<html><head><title>t</title><body><p>text") == "text"
    assert visible_text("<head><meta charset=x><title>a<b>c</title><style>a{}</style><!-- c -->\n<h1>z</h1>y") == "z\n\ny"
    assert visible_text("<head><link rel=x>text") == "text"
    assert visible_text("<head><noscript><img src=x></noscript><script>if(a<b){}</script></head><body>w") == "w"
    assert visible_text("<head><title>t</title></head>\n<header>h</header>") == "h"
