"""What each rule says of a finding and how to mend it; ``{value}`` is the finding's measure, ``{pages}`` its number of pages."""

from __future__ import annotations

ADVICE: dict[str, tuple[str, str]] = {
    # technical
    "soft-404": ("The page says that it was not found, yet it answers with status 200.", "Answer 404 or 410 for missing content, or bring the content back."),
    "redirect-chain": ("The address is reached through {value} redirects in a row.", "Redirect the first address straight to the last one."),
    "canonical-missing": ("An indexable page names no canonical address.", "Add a canonical link to the page's own preferred address."),
    "canonical-relative-url": ("The canonical address is relative.", "Write the canonical link with scheme and host."),
    "canonical-cross-host": ("The canonical link points to another host.", "Point it to this host, unless the other host is meant to be indexed instead."),
    "canonical-non-200": ("The canonical address fails or redirects.", "Point the canonical link to an address that answers 200 by itself."),
    "robots-noindex-conflict": ("The page is barred from the index, but the sitemap or {value} internal links lead to it.", "Lift the noindex, or take the page out of the sitemap and the links."),
    "meta-robots-nofollow": ("The whole page is marked nofollow, so none of its links pass anything on.", "Remove nofollow and mark single links instead."),
    "mixed-content": ("A secure page loads {value} resources over plain http.", "Load every resource over https."),
    "url-turkish-charset": ("The address holds Turkish letters as such.", "Use plain a-z in addresses and redirect the old ones."),
    "url-uppercase-underscore": ("The address has capitals or underscores.", "Use lower case and hyphens, and redirect the old address."),
    "url-excessive-depth": ("The address lies {value} levels deep.", "Bring it to four levels or fewer."),
    "robots-txt-missing": ("The site has no readable robots.txt.", "Publish one at the root; an empty rule set will do."),
    "sitemap-missing": ("No sitemap could be read.", "Publish an XML sitemap and name it in robots.txt."),
    "sitemap-invalid-xml": ("{value} of the named sitemaps cannot be read.", "Mend their XML or their address."),
    "sitemap-url-non-indexable": ("{value} sitemap entries fail, redirect or are barred from the index.", "List only addresses that answer 200 and may be indexed."),
    "sitemap-orphan-pages": ("{value} indexable pages are in no sitemap.", "Add them, or bar them from the index if they are not meant for it."),
    "sitemap-lastmod-invalid": ("{value} sitemap entries have a missing, malformed or future lastmod.", "Write lastmod as a W3C date of the last real change."),
    "http-status-error": ("{value} addresses of this site answer with an error.", "Restore them, redirect them, or remove the links to them."),
    "www-https-canonicalization": ("Pages are served both with and without www.", "Choose one host and redirect the other permanently."),
    "duplicate-content-cluster": ("{value} pairs of pages have almost the same content.", "Merge them, set canonical links, or tell them apart in substance."),
    "client-side-rendering": ("Half of the pages or more come nearly empty and are filled in the browser.", "Render the content on the server or in advance."),
    # onpage
    "title-missing": ("An indexable page has no title.", "Write a title that says what the page is about."),
    "title-pixel-width": ("The title is about {value} pixels wide and will be cut off in results.", "Shorten it to 580 pixels, the important words first."),
    "title-too-short": ("The title has only {value} characters.", "Use the room: name the subject and the site."),
    "meta-description-missing": ("The page has no meta description.", "Add one or two sentences that sum the page up."),
    "meta-description-length": ("The meta description has {value} characters, which is too short, or wider than results show.", "Aim for 70 to 155 characters."),
    "h1-missing": ("The page has no first-level heading.", "Give it one h1 that names its subject."),
    "h1-count": ("The page has {value} first-level headings.", "Keep one and lower the others."),
    "heading-hierarchy-skip": ("Heading levels are skipped {value} times.", "Step down one level at a time."),
    "heading-empty": ("A heading has no text.", "Fill it or remove it."),
    "thin-content": ("The main part has only {value} words.", "Say more that is of use, or merge the page with a related one."),
    "turkish-mojibake": ("Letters are garbled by a wrong character encoding.", "Store and serve the page as UTF-8 all the way from the database."),
    "charset-declaration-late": ("The character set is not declared within the first 1024 bytes.", "Put the charset declaration first in the head, or send it in the content-type header."),
    "viewport-meta-missing": ("The page does not adapt its width to the device.", "Add a viewport meta tag with width=device-width."),
    "lang-attribute-missing": ("The html element declares no language.", "Set its lang attribute."),
    "title-duplicate": ("{pages} pages share one title.", "Give each page a title of its own."),
    "meta-description-duplicate": ("{pages} pages share one meta description.", "Write one for each page."),
    # structured data
    "jsonld-parse-error": ("{value} JSON-LD blocks cannot be parsed.", "Mend the JSON; a validator shows the place."),
    "jsonld-missing": ("The page carries no structured data.", "Add JSON-LD of the type that fits its content."),
    "jsonld-context-invalid": ("A JSON-LD block does not use the schema.org context.", "Set @context to https://schema.org."),
    "jsonld-required-props": ("{value} structured-data items lack properties that results need.", "Fill in the missing properties."),
    "jsonld-faq-mismatch": ("{value} questions in the FAQ data cannot be seen on the page.", "Mark up only questions that visitors can read."),
    "jsonld-service-missing": ("A page on a service has no service or offer data.", "Describe the service in JSON-LD."),
    "jsonld-breadcrumb-missing": ("A page below the first level has no breadcrumb data.", "Add a BreadcrumbList."),
    "og-missing": ("Open Graph tags for title, description, image or url are missing.", "Add the four tags, so that shared links show a preview."),
    "twitter-card-missing": ("The page has no twitter:card tag.", "Add one, summary_large_image for instance."),
    "jsonld-organization-missing": ("The home page does not say which organisation runs the site.", "Add Organization data with name, address and logo."),
    "jsonld-sameas-missing": ("The organisation's data link to no profile elsewhere.", "List official profiles under sameAs."),
    # performance
    "render-blocking-css": ("{value} style sheets block the first paint.", "Inline what is critical and load the rest later."),
    "render-blocking-js": ("{value} scripts in the head block the first paint.", "Load them with defer or async."),
    "lcp-candidate-lazy": ("The first large image is loaded lazily.", "Load it eagerly and with high priority."),
    "no-compression": ("A page of {value} bytes is sent uncompressed.", "Turn on Brotli or gzip for text."),
    "ttfb-slow": ("The first byte took {value} ms.", "Cache pages and look for slow queries; aim for less than 800 ms."),
    "html-size-excessive": ("The HTML alone weighs {value} bytes.", "Move inline data out and remove unused markup."),
    "dom-node-count": ("The page has {value} elements.", "Flatten the markup, and load long lists in parts."),
    "inline-style-bloat": ("Inline styles make up {value} bytes.", "Move them to a cached style sheet."),
    "third-party-script-count": ("Scripts come from {value} other hosts.", "Remove those without use and delay the rest."),
    "font-display-missing": ("Web fonts may hide the text while they load.", "Set font-display: swap."),
    "preconnect-missing": ("Other hosts are used without an early connection.", "Add preconnect hints for the important ones."),
    # i18n
    "lang-attribute-mismatch": ("The text is Turkish, but another language is declared.", "Set lang to the language of the text."),
    "lang-region-format": ("The declared language is no valid tag.", "Write it as in tr or en-GB."),
    "hreflang-invalid-code": ("An alternate names an invalid language code.", "Use ISO codes, as in tr, en-GB or x-default."),
    "hreflang-self-missing": ("The alternates leave out the page itself.", "Add the page's own language and address to the set."),
    "hreflang-return-tag": ("{value} alternates do not point back.", "Make every alternate name this page as well."),
    "hreflang-non-200": ("{value} alternates fail or redirect.", "Point them to addresses that answer 200."),
    "hreflang-canonical-conflict": ("The page names alternates, but its canonical is another page.", "Use alternates on canonical pages only."),
    "hreflang-x-default-missing": ("There is no alternate for visitors of other languages.", "Add an x-default alternate."),
    "hreflang-missing-multilocale": ("Pages are in several languages without alternates between them.", "Link the versions by hreflang."),
    # ai-search
    "ai-crawler-blocked": ("robots.txt shuts out {value} crawlers of AI search.", "Decide whether that is meant; if not, allow them."),
    "llms-txt-missing": ("The site has no llms.txt.", "Publish one that points to the main pages."),
    "content-server-rendered": ("The content is not in the HTML that the server sends.", "Render the main text on the server."),
    "answerable-summary-missing": ("The first paragraph is no summary that could be quoted: it has {value} characters.", "Open with an answer of 80 to 400 characters."),
    "faq-block-missing": ("A page on a service answers no questions.", "Add a short list of common questions with answers."),
    "content-freshness-missing": ("Nothing tells when the text was written or revised.", "Show the date, and give it in structured data."),
    "heading-question-form": ("A long text has hardly any headings in the form of a question.", "Phrase some headings as people would ask."),
    "toc-missing": ("A long text has no table of contents.", "Link its sections at the top."),
    # links
    "broken-internal-link": ("{value} internal links lead to an error.", "Mend or remove them."),
    "internal-redirect-link": ("{value} internal links go through a redirect.", "Link to the final address."),
    "anchor-text-generic": ("{value} links have a text that says nothing.", "Name the target in the link."),
    "anchor-text-empty": ("A link has neither text nor a label.", "Add text, an alt text or an aria-label."),
    "target-blank-no-noopener": ("A link opens a new window without noopener.", "Add rel=noopener."),
    "internal-link-nofollow": ("An internal link is marked nofollow.", "Remove the mark."),
    "internal-links-few": ("The main part has only {value} internal links.", "Link to three related pages or more."),
    "excessive-links": ("The page has {value} links.", "Cut down on repeated menus and long lists."),
    "link-to-http": ("A secure page links to this site over plain http.", "Use https in internal links."),
    "orphan-page": ("No internal link leads to {value} of the pages.", "Link to them from related pages or the menu."),
    # media
    "img-missing-alt": ("{value} images have no alt attribute.", "Describe them, or set an empty alt where they only decorate."),
    "img-alt-quality": ("An alt text is too long, repeats words or is the file name.", "Describe in a short phrase what the image shows."),
    "img-missing-dimensions": ("{value} images reserve no space, so the layout jumps.", "Set width and height or an aspect ratio."),
    "img-legacy-format": ("Images are served in JPEG or PNG only.", "Offer WebP or AVIF."),
    "img-lazy-missing": ("Images further down are loaded at once.", "Set loading=lazy on them."),
    "img-filename-quality": ("An image's file name says nothing or has letters outside ASCII.", "Name files by what they show, in a-z and hyphens."),
    "video-missing-schema": ("A video has no structured data.", "Add VideoObject data."),
    "audio-missing-transcript": ("Audio comes without structured data and a transcript.", "Add AudioObject data and the text of what is said."),
    "iframe-missing-title": ("An embedded frame has no title.", "Say in its title what it holds."),
    # security
    "hsts-missing": ("The server does not insist on https.", "Send strict-transport-security."),
    "hsts-weak": ("The strict-transport-security period is under 180 days.", "Set max-age to a year."),
    "csp-missing": ("There is no content security policy.", "Start with a policy in report-only mode and tighten it."),
    "csp-unsafe": ("The content security policy allows inline code, eval or any script host.", "Use nonces or hashes and name the hosts."),
    "x-content-type-options-missing": ("Browsers may guess content types.", "Send x-content-type-options: nosniff."),
    "clickjacking-protection-missing": ("Any site may frame this page.", "Send frame-ancestors in the policy, or x-frame-options."),
    "referrer-policy-missing": ("No referrer policy is set.", "Send strict-origin-when-cross-origin."),
    "permissions-policy-missing": ("Device features are not restricted.", "Send a permissions-policy that turns off what is not used."),
    "cookie-flags-weak": ("A cookie lacks Secure, HttpOnly or SameSite.", "Set all three."),
    "server-version-disclosure": ("Response headers give away software versions.", "Hide them in the server's configuration."),
    "sri-missing": ("{value} scripts of other hosts have no integrity hash.", "Add integrity and crossorigin attributes."),
}
