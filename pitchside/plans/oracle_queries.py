"""One DuckDB statement per registered query (same column names)."""

from __future__ import annotations

from pitchside.plans.oracles import standings_sql, with_base

ST_COLS = ("competition, season, position, team_id, name, short_name, played, won, drawn, lost, "
           "goals_for, goals_against, goal_difference, points, form, primary_color, secondary_color, slug")

ORACLES: dict[str, str] = {}

ORACLES["derived_matchweeks"] = with_base("SELECT id, competition, season, matchweek FROM dmw")

ORACLES["club_matches"] = with_base("""
SELECT id, competition, season, matchweek, kicks_off_at, team_id, opponent_id, goals_for, goals_against,
       venue, outcome,
       CAST(row_number() OVER (PARTITION BY competition, season, team_id
                               ORDER BY kicks_off_at DESC, id DESC) AS INTEGER) AS recency
FROM cm""")

ORACLES["standings"] = with_base(standings_sql() + f"\nSELECT {ST_COLS} FROM st")

from pitchside.plans.oracles import BASE, HISTORY_SQL, mini_league_sql  # noqa: E402


def _st(**kw) -> str:
    return standings_sql(**kw)


# ---- standings family -----------------------------------------------------

ORACLES["standings_upto"] = with_base(
    ",\ncm_u AS (SELECT * FROM cm WHERE matchweek <= 19)" + _st(cm="cm_u") + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_home"] = with_base(
    ",\ncm_h AS (SELECT * FROM cm WHERE venue = 'home')" + _st(cm="cm_h") + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_away"] = with_base(
    ",\ncm_a AS (SELECT * FROM cm WHERE venue = 'away')" + _st(cm="cm_a") + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_last6"] = with_base(_st(last_n=6) + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_top6"] = with_base(
    _st(name="base") + mini_league_sql("base", "top6", "cm_t") + _st(cm="cm_t") + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_bottom_half"] = with_base(
    _st(name="base") + mini_league_sql("base", "bottom-half", "cm_b") + _st(cm="cm_b")
    + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_sorted"] = with_base(_st() + f"""
SELECT {ST_COLS},
       CAST(row_number() OVER (PARTITION BY competition, season
            ORDER BY goals_against ASC, points DESC, goal_difference DESC, goals_for DESC, name ASC) AS INTEGER)
       AS display_rank
FROM st""")
ORACLES["standings_sorted_unknown"] = with_base(_st() + f"""
SELECT {ST_COLS},
       CAST(row_number() OVER (PARTITION BY competition, season ORDER BY position DESC) AS INTEGER) AS display_rank
FROM st""")
ORACLES["standings_filtered"] = with_base(
    ",\ncm_f AS (SELECT * FROM cm WHERE competition = 'lg.0' AND season = 1996 AND team_id BETWEEN 1 AND 6"
    " AND opponent_id BETWEEN 1 AND 6)" + _st(cm="cm_f") + f"\nSELECT {ST_COLS} FROM st")
ORACLES["standings_views"] = with_base(
    _st()
    + _st(last_n=6, name="st_form")
    + ",\ncm_h AS (SELECT * FROM cm WHERE venue = 'home')" + _st(cm="cm_h", name="st_home")
    + ",\ncm_a AS (SELECT * FROM cm WHERE venue = 'away')" + _st(cm="cm_a", name="st_away")
    + mini_league_sql("st", "top6", "cm_t") + _st(cm="cm_t", name="st_top6")
    + f"""
SELECT {ST_COLS}, 'full' AS view FROM st
UNION ALL SELECT {ST_COLS}, 'form' FROM st_form
UNION ALL SELECT {ST_COLS}, 'home' FROM st_home
UNION ALL SELECT {ST_COLS}, 'away' FROM st_away
UNION ALL SELECT {ST_COLS}, 'top6' FROM st_top6""")
ORACLES["points_gaps"] = with_base(_st() + """,
spine AS (SELECT competition, season,
                 CAST(unnest(generate_series(max(points), min(points), -1)) AS INTEGER) AS points
          FROM st GROUP BY competition, season)
SELECT g.competition, g.season, g.points, s.team_id, s.short_name, s.played, s.position
FROM spine g LEFT JOIN st s ON s.competition = g.competition AND s.season = g.season AND s.points = g.points""")

_SPLIT_COLS = ("played", "won", "drawn", "lost", "goals_for", "goals_against", "points", "position")
ORACLES["home_away_split"] = with_base(
    ",\ncm_h AS (SELECT * FROM cm WHERE venue = 'home')" + _st(cm="cm_h", name="sh")
    + ",\ncm_a AS (SELECT * FROM cm WHERE venue = 'away')" + _st(cm="cm_a", name="sa")
    + "\nSELECT h.competition, h.season, h.team_id, h.name, "
    + ", ".join([f"h.{c} AS home_{c}" for c in _SPLIT_COLS] + [f"a.{c} AS away_{c}" for c in _SPLIT_COLS])
    + "\nFROM sh h JOIN sa a ON a.competition = h.competition AND a.season = h.season AND a.team_id = h.team_id")
ORACLES["history_groups"] = with_base(_st() + HISTORY_SQL + """,
n AS (SELECT competition, season, count(*) AS n FROM st GROUP BY competition, season),
grp AS (
  SELECT s.competition, s.season, 'top6' AS "group", s.team_id FROM st s WHERE s.position <= 6
  UNION ALL
  SELECT s.competition, s.season, 'bottom6', s.team_id FROM st s JOIN n USING (competition, season)
  WHERE s.position > n.n - 6)
SELECT p.competition, p.season, g."group", p.matchweek, p.team_id, p.position, p.points
FROM ph p JOIN grp g ON g.competition = p.competition AND g.season = p.season AND g.team_id = p.team_id""")

# ---- streaks, head-to-head, history ---------------------------------------

# Streaks from one ordered list per club: the place of the first result that
# breaks the run, or the whole list.
def _run(column: str, test: str) -> str:
    return (f"CAST(coalesce(nullif(list_position(list_transform({column}, lambda x: {test}), true), 0), len({column}) + 1) - 1 "
            "AS INTEGER)")


_STREAKS = """,
lists AS (
  SELECT competition, season, team_id, list(outcome ORDER BY kicks_off_at DESC, id DESC) AS res,
         list(goals_against ORDER BY kicks_off_at DESC, id DESC) AS conceded
  FROM {cm} GROUP BY competition, season, team_id)
SELECT r.competition, r.season, t.id AS team_id, t.name, t.short_name, CAST(len(res) AS INTEGER) AS played,
       """ + _run("res", "x <> 'W'") + """ AS win_streak,
       """ + _run("res", "x = 'L'") + """ AS unbeaten_streak,
       """ + _run("res", "x = 'W'") + """ AS winless_streak,
       """ + _run("conceded", "x > 0") + """ AS clean_sheet_streak
FROM lists r JOIN teams t ON t.id = r.team_id"""
ORACLES["streaks"] = with_base(_STREAKS.format(cm="cm"))
ORACLES["streaks_home"] = with_base(
    ",\ncm_h AS (SELECT * FROM cm WHERE venue = 'home')" + _STREAKS.format(cm="cm_h"))

# Independent of the fan-out: one sum per fixture direction, then both
# directions of a pair added up.
ORACLES["head_to_head"] = with_base("""
, way AS (
  SELECT competition, home_team_id AS h, away_team_id AS a, count(*) AS n,
         sum(CASE WHEN home_goals > away_goals THEN 1 ELSE 0 END) AS hw, sum(CASE WHEN home_goals < away_goals THEN 1 ELSE 0 END) AS aw,
         sum(home_goals) AS hg, sum(away_goals) AS ag
  FROM matches WHERE status = 'finished' AND home_goals IS NOT NULL AND away_goals IS NOT NULL
  GROUP BY competition, home_team_id, away_team_id),
sides AS (SELECT competition, h AS x, a AS y, n, hw AS w, aw AS l, hg AS f, ag AS c FROM way
          UNION ALL SELECT competition, a, h, n, aw, hw, ag, hg FROM way)
SELECT competition, x AS team_a_id, y AS team_b_id, CAST(sum(n) AS INTEGER) AS played, CAST(sum(w) AS INTEGER) AS team_a_wins,
       CAST(sum(n) - sum(w) - sum(l) AS INTEGER) AS draws, CAST(sum(l) AS INTEGER) AS team_b_wins,
       CAST(sum(f) AS INTEGER) AS team_a_goals, CAST(sum(c) AS INTEGER) AS team_b_goals
FROM sides GROUP BY competition, x, y""")
ORACLES["meetings"] = with_base("""
, pm AS (SELECT *, least(home_team_id, away_team_id) AS team_a_id, greatest(home_team_id, away_team_id) AS team_b_id
         FROM matches WHERE status = 'finished' AND home_goals IS NOT NULL AND away_goals IS NOT NULL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY competition, team_a_id, team_b_id
                                        ORDER BY kicks_off_at DESC, id DESC) AS INTEGER) AS meeting FROM pm)
SELECT rk.competition, rk.team_a_id, rk.team_b_id, rk.meeting, rk.id, rk.season, rk.kicks_off_at,
       h.short_name AS home_name, a.short_name AS away_name, rk.home_goals, rk.away_goals
FROM rk JOIN teams h ON h.id = rk.home_team_id JOIN teams a ON a.id = rk.away_team_id
WHERE rk.meeting <= 10""")
ORACLES["position_history"] = with_base(HISTORY_SQL + "\nSELECT * FROM ph")
ORACLES["table_at_week"] = with_base(HISTORY_SQL + "\nSELECT * FROM ph WHERE matchweek = 19")
ORACLES["club_line"] = with_base(HISTORY_SQL + """,
fin AS (SELECT competition, season, team_id, max(matchweek) AS last_week FROM ph GROUP BY ALL)
SELECT p.competition, p.season, p.team_id, p.matchweek, p.position, l.position AS final_position
FROM ph p JOIN fin f USING (competition, season, team_id)
JOIN ph l ON l.competition = f.competition AND l.season = f.season AND l.team_id = f.team_id
         AND l.matchweek = f.last_week""")
ORACLES["latest_season"] = with_base("""
, ls AS (SELECT competition, max(season) FILTER (WHERE status = 'finished') AS season FROM matches GROUP BY competition)
SELECT competition, season,
       CASE WHEN season IS NOT NULL THEN concat(CAST(season AS VARCHAR), '/', substr(CAST(season + 1 AS VARCHAR), 3, 2))
       END AS season_label
FROM ls""")

# ---- clubs, colours -----------------------------------------------------------

_FIXTURES = """
, fx AS (
  SELECT f.competition, f.season, f.team_id, f.id, f.matchweek, f.kicks_off_at, f.status, f.venue,
         f.opponent_id, t.name AS opponent_name, t.slug AS opponent_slug, f.goals_for, f.goals_against,
         CASE WHEN f.status = 'finished' AND f.goals_for IS NOT NULL AND f.goals_against IS NOT NULL THEN
           CASE WHEN f.goals_for > f.goals_against THEN 'W' WHEN f.goals_for = f.goals_against THEN 'D' ELSE 'L' END
         END AS outcome
  FROM fan f JOIN teams t ON t.id = f.opponent_id)"""
ORACLES["club_fixtures"] = with_base(_FIXTURES + "\nSELECT * FROM fx")
ORACLES["results_list"] = with_base(_FIXTURES + "\nSELECT * FROM fx WHERE outcome IS NOT NULL")
_NEXT = """
, nx AS (
  SELECT f.competition, f.team_id, f.id, f.kicks_off_at, f.venue, f.opponent_id,
         row_number() OVER (PARTITION BY f.competition, f.team_id ORDER BY f.kicks_off_at, f.id) AS rn
  FROM fan f WHERE f.status IN ('scheduled', 'live') AND f.kicks_off_at >= TIMESTAMP '1998-01-01 00:00:00'),
nf AS (
  SELECT n.competition, n.team_id, n.id, n.kicks_off_at, n.venue, n.opponent_id, t.name AS opponent_name,
         t.slug AS opponent_slug
  FROM nx n JOIN teams t ON t.id = n.opponent_id WHERE n.rn = 1)"""
ORACLES["next_fixture"] = with_base(_NEXT + "\nSELECT * FROM nf")
ORACLES["slugs"] = with_base("""
, o AS (SELECT slug, min(id) AS owner, CAST(count(*) AS INTEGER) AS n FROM teams GROUP BY slug)
SELECT t.id, t.name, t.slug, t.id = o.owner AS owns_slug, o.n AS slug_collisions
FROM teams t JOIN o USING (slug)""")
ORACLES["club_profile"] = with_base(
    _st() + _st(last_n=6, name="st6")
    + ",\ncm_h AS (SELECT * FROM cm WHERE venue = 'home')" + _st(cm="cm_h", name="sh")
    + ",\ncm_a AS (SELECT * FROM cm WHERE venue = 'away')" + _st(cm="cm_a", name="sa")
    + _NEXT + """,
lists AS (
  SELECT competition, season, team_id, list(outcome ORDER BY kicks_off_at DESC, id DESC) AS res,
         list(goals_against ORDER BY kicks_off_at DESC, id DESC) AS conceded
  FROM cm GROUP BY competition, season, team_id),
sk AS (
  SELECT competition, season, team_id, """ + _run("res", "x <> 'W'") + """ AS win_streak,
         """ + _run("res", "x = 'L'") + """ AS unbeaten_streak, """ + _run("res", "x = 'W'") + """ AS winless_streak,
         """ + _run("conceded", "x > 0") + """ AS clean_sheet_streak
  FROM lists),
hh AS (
  SELECT competition, team_id AS a, opponent_id AS b, CAST(count(*) AS INTEGER) AS played,
         CAST(sum(CASE outcome WHEN 'W' THEN 1 ELSE 0 END) AS INTEGER) AS w,
         CAST(sum(CASE outcome WHEN 'D' THEN 1 ELSE 0 END) AS INTEGER) AS d,
         CAST(sum(CASE outcome WHEN 'L' THEN 1 ELSE 0 END) AS INTEGER) AS l
  FROM cm GROUP BY competition, team_id, opponent_id)
SELECT s.competition, s.season, s.team_id, s.name, s.slug, s.position, s.played, s.points, s.form,
       CAST(count(*) OVER (PARTITION BY s.competition, s.season) AS INTEGER) AS clubs,
       f.won AS form6_won, f.drawn AS form6_drawn, f.lost AS form6_lost, f.points AS form6_points,
       k.win_streak, k.unbeaten_streak, k.winless_streak, k.clean_sheet_streak,
       CASE WHEN a.team_id IS NOT NULL THEN h.position END AS home_position,
       CASE WHEN a.team_id IS NOT NULL THEN h.points END AS home_points,
       CASE WHEN h.team_id IS NOT NULL THEN a.position END AS away_position,
       CASE WHEN h.team_id IS NOT NULL THEN a.points END AS away_points,
       n.opponent_id AS next_opponent_id, n.kicks_off_at AS next_kicks_off_at, n.venue AS next_venue,
       CASE WHEN n.opponent_id IS NOT NULL THEN coalesce(x.played, 0) END AS h2h_played,
       CASE WHEN n.opponent_id IS NOT NULL THEN coalesce(x.w, 0) END AS h2h_wins,
       CASE WHEN n.opponent_id IS NOT NULL THEN coalesce(x.d, 0) END AS h2h_draws,
       CASE WHEN n.opponent_id IS NOT NULL THEN coalesce(x.l, 0) END AS h2h_losses
FROM st s
LEFT JOIN st6 f ON f.competition = s.competition AND f.season = s.season AND f.team_id = s.team_id
LEFT JOIN sk k ON k.competition = s.competition AND k.season = s.season AND k.team_id = s.team_id
LEFT JOIN sh h ON h.competition = s.competition AND h.season = s.season AND h.team_id = s.team_id
LEFT JOIN sa a ON a.competition = s.competition AND a.season = s.season AND a.team_id = s.team_id
LEFT JOIN nf n ON n.competition = s.competition AND n.team_id = s.team_id
LEFT JOIN hh x ON x.competition = s.competition AND x.a = s.team_id AND x.b = n.opponent_id""")


def _ch(v: str) -> str:
    return f"(CASE WHEN ({v}) / 255.0 <= 0.03928 THEN ({v}) / 255.0 / 12.92 ELSE pow((({v}) / 255.0 + 0.055) / 1.055, 2.4) END)"


def _lum(r: str, g: str, b: str) -> str:
    return f"(0.2126 * {_ch(r)} + 0.7152 * {_ch(g)} + 0.0722 * {_ch(b)})"


def _contrast(la: str, lb: str) -> str:
    return f"((greatest({la}, {lb}) + 0.05) / (least({la}, {lb}) + 0.05))"


def _hexpart(h: str, i: int) -> str:
    digits = "'0123456789abcdef'"
    return (f"CAST((instr({digits}, substr({h}, {i}, 1)) - 1) * 16 + (instr({digits}, substr({h}, {i + 1}, 1)) - 1)"
            f" AS DOUBLE)")


def _tohex(x: str) -> str:
    return f"lpad(lower(hex(CAST(greatest(0, least(255, floor({x} + 0.5))) AS BIGINT))), 2, '0')"


def _sat(r: str, g: str, b: str) -> str:
    mx, mn = f"(greatest({r}, {g}, {b}) / 255.0)", f"(least({r}, {g}, {b}) / 255.0)"
    return (f"(CASE WHEN {mx} = {mn} THEN 0.0 WHEN ({mx} + {mn}) / 2 > 0.5 THEN ({mx} - {mn}) / (2 - {mx} - {mn})"
            f" ELSE ({mx} - {mn}) / ({mx} + {mn}) END)")


def _clean(x: str) -> str:
    h = f"lower(regexp_replace(trim({x}), '^#', ''))"
    return f"(CASE WHEN regexp_full_match({h}, '[0-9a-f]{{6}}') THEN {h} END)"


_COLOURS = BASE.replace("WITH teams0", "WITH RECURSIVE teams0", 1) + f""",
hx AS (SELECT id, name, {_clean('primary_color')} AS ph, {_clean('secondary_color')} AS sh FROM teams),
cols AS (SELECT id, name, {_hexpart('ph', 1)} AS pr, {_hexpart('ph', 3)} AS pg, {_hexpart('ph', 5)} AS pb,
                {_hexpart('sh', 1)} AS sr, {_hexpart('sh', 3)} AS sg, {_hexpart('sh', 5)} AS sb FROM hx),
grounds AS (SELECT * FROM (VALUES ('light', 244.0, 242.0, 237.0, '14161a'), ('dark', 20.0, 22.0, 26.0, 'e9e6df'))
            g(ground, gr, gg, gb, fallback)),
gl AS (SELECT *, {_lum('gr', 'gg', 'gb')} AS lg FROM grounds),
c0 AS (
  SELECT c.*, g.ground, g.lg, g.lg > 0.5 AS is_light, g.fallback,
         CASE WHEN c.pr IS NULL THEN TRUE ELSE {_sat('c.pr', 'c.pg', 'c.pb')} < 0.15 END AS p_achro,
         {_contrast(_lum('c.pr', 'c.pg', 'c.pb'), 'g.lg')} AS p_con,
         {_contrast(_lum('c.sr', 'c.sg', 'c.sb'), 'g.lg')} AS s_con
  FROM cols c CROSS JOIN gl g),
c1 AS (
  SELECT *, (p_achro AND sr IS NOT NULL) AS use_s,
         CASE WHEN p_achro AND sr IS NOT NULL THEN sr ELSE pr END AS br,
         CASE WHEN p_achro AND sr IS NOT NULL THEN sg ELSE pg END AS bg,
         CASE WHEN p_achro AND sr IS NOT NULL THEN sb ELSE pb END AS bb
  FROM c0),
adj(id, ground, is_light, lg, i, r, g, b) AS (
  SELECT id, ground, is_light, lg, 0, br, bg, bb FROM c1 WHERE br IS NOT NULL
  UNION ALL
  SELECT id, ground, is_light, lg, i + 1,
         CASE WHEN is_light THEN 0.95 * r ELSE r + (255.0 - r) * 0.08 END,
         CASE WHEN is_light THEN 0.95 * g ELSE g + (255.0 - g) * 0.08 END,
         CASE WHEN is_light THEN 0.95 * b ELSE b + (255.0 - b) * 0.08 END
  FROM adj WHERE i < 40 AND {_contrast(_lum('r', 'g', 'b'), 'lg')} < 3),
fin AS (SELECT id, ground, arg_max(r, i) AS r, arg_max(g, i) AS g, arg_max(b, i) AS b FROM adj GROUP BY id, ground),
res AS (
  SELECT c.id, c.name, c.ground,
         CASE WHEN c.pr IS NOT NULL AND c.p_con >= 3 THEN {_tohex('c.pr')} || {_tohex('c.pg')} || {_tohex('c.pb')}
              WHEN c.p_achro AND c.sr IS NOT NULL AND c.s_con >= 3 THEN {_tohex('c.sr')} || {_tohex('c.sg')} || {_tohex('c.sb')}
              WHEN c.br IS NULL THEN c.fallback
              ELSE {_tohex('f.r')} || {_tohex('f.g')} || {_tohex('f.b')} END AS hex,
         CASE WHEN c.pr IS NOT NULL AND c.p_con >= 3 THEN 'primary'
              WHEN c.p_achro AND c.sr IS NOT NULL AND c.s_con >= 3 THEN 'secondary'
              WHEN c.br IS NULL THEN 'fallback'
              WHEN c.use_s THEN 'adjusted-secondary' ELSE 'adjusted-primary' END AS source,
         round(CASE WHEN c.pr IS NOT NULL AND c.p_con >= 3 THEN c.p_con
              WHEN c.p_achro AND c.sr IS NOT NULL AND c.s_con >= 3 THEN c.s_con
              WHEN c.br IS NULL THEN {_contrast(_lum(_hexpart('c.fallback', 1), _hexpart('c.fallback', 3), _hexpart('c.fallback', 5)), 'c.lg')}
              ELSE {_contrast(_lum('f.r', 'f.g', 'f.b'), 'c.lg')} END, 6) AS contrast
  FROM c1 c LEFT JOIN fin f ON f.id = c.id AND f.ground = c.ground)"""
ORACLES["club_colours"] = _COLOURS + """
SELECT l.id, l.name, l.hex AS light_hex, l.source AS light_source, l.contrast AS light_contrast,
       d.hex AS dark_hex, d.source AS dark_source, d.contrast AS dark_contrast,
       '#' || l.hex AS css_light, '#' || d.hex AS css_dark
FROM res l JOIN res d ON d.id = l.id AND d.ground = 'dark' WHERE l.ground = 'light'"""
ORACLES["color_audit"] = _COLOURS + """
SELECT ground, CAST(count(*) AS INTEGER) AS clubs, CAST(count(*) FILTER (WHERE contrast < 3) AS INTEGER)
       AS below_threshold, min(contrast) AS worst_ratio
FROM res GROUP BY ground"""
ORACLES["feed_windows"] = with_base("""
SELECT id,
       strftime(kicks_off_at - INTERVAL 3 DAY, '%Y%m%d') || '-' || strftime(kicks_off_at + INTERVAL 10 DAY, '%Y%m%d')
         AS recent_window,
       CAST(season AS VARCHAR) || '0701-' || CAST(season + 1 AS VARCHAR) || '0630' AS season_window,
       CAST(season AS VARCHAR) || '/' || substr(CAST(season + 1 AS VARCHAR), 3, 2) AS season_label
FROM matches""")

# ---- quality and audit -----------------------------------------------------------

ORACLES["feed_health"] = with_base("""
SELECT (SELECT count(*) FROM matches) AS matches,
       (SELECT count(*) FROM teams) AS teams,
       (SELECT max(updated_at) FROM matches) AS last_ingest_at,
       CAST(floor((epoch(TIMESTAMP '2001-09-01 00:00:00') - epoch((SELECT max(updated_at) FROM matches))) / 60.0 + 0.5)
            AS INTEGER) AS age_minutes""")
ORACLES["status_counts"] = with_base(
    "SELECT season, status, count(*) AS n FROM matches GROUP BY season, status")
ORACLES["duplicate_keys"] = with_base("""
SELECT (SELECT count(*) FROM teams) AS teams,
       (SELECT count(*) FROM matches) AS matches,
       (SELECT count(*) FROM (SELECT external_id FROM matches GROUP BY external_id
                                              HAVING count(*) > 1) d) AS duplicate_external_ids,
       (SELECT count(*) FROM (SELECT external_id FROM teams GROUP BY external_id
                                              HAVING count(*) > 1) d) AS duplicate_team_external_ids""")
_DCM = """
, dcm AS (
  SELECT d.competition, d.season, d.matchweek, m.id, m.kicks_off_at, m.home_team_id AS team_id
  FROM dmw d JOIN matches m ON m.id = d.id
  UNION ALL
  SELECT d.competition, d.season, d.matchweek, m.id, m.kicks_off_at, m.away_team_id
  FROM dmw d JOIN matches m ON m.id = d.id)"""
# Each club match against the one before it, by a self-join on its number.
ORACLES["matchweek_monotonic"] = with_base(_DCM + """
, s AS (SELECT *, row_number() OVER (PARTITION BY competition, season, team_id ORDER BY kicks_off_at, id) AS k FROM dcm)
SELECT x.competition, x.season, CAST(sum(CASE WHEN x.matchweek < y.matchweek THEN 1 ELSE 0 END) AS INTEGER) AS violations
FROM s x LEFT JOIN s y ON y.competition = x.competition AND y.season = x.season AND y.team_id = x.team_id AND y.k = x.k - 1
GROUP BY x.competition, x.season""")
# Games of the club up to each row, counted by a join to the rows not after it.
ORACLES["matchweek_overplayed"] = with_base(_DCM + """
, c AS (
  SELECT x.competition, x.season, x.team_id, x.id, x.matchweek, count(*) AS upto
  FROM dcm x JOIN dcm y ON y.competition = x.competition AND y.season = x.season AND y.team_id = x.team_id
   AND (y.matchweek < x.matchweek OR (y.matchweek = x.matchweek AND y.id <= x.id))
  GROUP BY ALL)
SELECT competition, season, CAST(sum(CASE WHEN upto > matchweek THEN 1 ELSE 0 END) AS INTEGER) AS violations
FROM c GROUP BY competition, season""")
ORACLES["games_per_club"] = with_base(_DCM + """
, g AS (SELECT competition, season, team_id, count(*) AS games FROM dcm GROUP BY ALL)
SELECT competition, season, CAST(min(games) AS INTEGER) AS min_games, CAST(max(games) AS INTEGER) AS max_games,
       CAST(count(*) AS INTEGER) AS clubs
FROM g GROUP BY competition, season""")
ORACLES["league_balance"] = with_base(
    _st()
    + ",\ncm_h AS (SELECT * FROM cm WHERE venue = 'home')" + _st(cm="cm_h", name="sh")
    + ",\ncm_a AS (SELECT * FROM cm WHERE venue = 'away')" + _st(cm="cm_a", name="sa") + """,
t AS (SELECT competition, season, CAST(count(*) AS INTEGER) AS clubs, CAST(sum(played) AS INTEGER) AS sum_played,
             CAST(sum(goals_for) AS INTEGER) AS sum_goals_for, CAST(sum(goals_against) AS INTEGER) AS sum_goals_against,
             CAST(sum(goal_difference) AS INTEGER) AS sum_goal_difference FROM st GROUP BY ALL),
h AS (SELECT competition, season, CAST(sum(played) AS INTEGER) AS home_played FROM sh GROUP BY ALL),
a AS (SELECT competition, season, CAST(sum(played) AS INTEGER) AS away_played FROM sa GROUP BY ALL),
n AS (SELECT competition, season, CAST(count(*) AS INTEGER) AS played_matches FROM matches
      WHERE status = 'finished' AND home_goals IS NOT NULL AND away_goals IS NOT NULL GROUP BY ALL)
SELECT t.*, h.home_played, a.away_played, n.played_matches,
       (t.sum_goals_for = t.sum_goals_against AND t.sum_goal_difference = 0
        AND t.sum_played = 2 * n.played_matches AND h.home_played + a.away_played = t.sum_played) AS balanced
FROM t LEFT JOIN h USING (competition, season) LEFT JOIN a USING (competition, season)
LEFT JOIN n USING (competition, season)""")
ORACLES["history_shape"] = with_base(HISTORY_SQL + """
SELECT competition, season, CAST(count(*) AS INTEGER) AS points, CAST(count(DISTINCT team_id) AS INTEGER) AS clubs,
       CAST(max(matchweek) AS INTEGER) AS weeks,
       CAST(count(DISTINCT team_id) * max(matchweek) AS INTEGER) AS expected,
       count(*) = count(DISTINCT team_id) * max(matchweek) AS complete
FROM ph GROUP BY competition, season""")
ORACLES["leaders"] = with_base(
    _st() + "\nSELECT competition, season, position, team_id, short_name, points FROM st WHERE position <= 5")
ORACLES["unbeaten_leaders"] = with_base(
    _STREAKS.format(cm="cm").replace("SELECT r.competition", ", s0 AS (SELECT r.competition", 1)
    .rstrip() + """)
, s1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY competition, season
                                          ORDER BY unbeaten_streak DESC, name ASC) AS INTEGER) AS rank FROM s0)
SELECT competition, season, rank, team_id, short_name, unbeaten_streak, win_streak FROM s1 WHERE rank <= 5""")

# ---- feed, normalisation, upsert ------------------------------------------------

# What the damaged feed says, after the fallbacks.
_FEED = """,
said AS (
  SELECT m.id, m.external_id, m.competition, m.kicks_off_at, m.minute AS shown_minute, m.stoppage_minute AS shown_stoppage,
         m.id % 211 = 0 OR m.id % 223 = 0 AS unparseable, m.id % 223 = 0 AS no_date,
         CASE WHEN m.id % 13 <> 5 THEN m.status WHEN m.status IN ('scheduled', 'live') THEN m.status ELSE 'finished' END AS status,
         CASE WHEN m.id % 193 = 0 THEN 1066 ELSE m.season END AS season,
         CASE WHEN m.id % 199 = 0 THEN concat('ghost-', m.id) ELSE h.external_id END AS home_ext,
         CASE WHEN m.id % 199 = 0 THEN '' ELSE h.name END AS home_name,
         CASE WHEN m.id % 17 <> 4 THEN h.short_name WHEN m.id % 199 = 0 THEN '' ELSE h.name END AS home_short,
         h.primary_color AS home_primary, a.external_id AS away_ext, CASE WHEN m.id % 197 = 0 THEN '' ELSE a.name END AS away_name,
         a.secondary_color AS away_secondary,
         CASE WHEN m.id % 191 = 0 THEN -1 ELSE m.home_goals END AS home_goals, m.away_goals
  FROM matches m JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id)"""
ORACLES["normalize_events"] = with_base(_FEED + """
SELECT external_id, competition, season, kicks_off_at, status, home_ext AS home_external_id, home_name,
       home_short AS home_short_name, home_primary AS home_primary_color, away_ext AS away_external_id,
       away_secondary AS away_secondary_color, home_goals, away_goals,
       CASE WHEN status = 'live' THEN shown_minute END AS minute,
       CASE WHEN status = 'live' THEN shown_stoppage END AS stoppage_minute
FROM said WHERE NOT unparseable""")
ORACLES["quarantine"] = with_base(
    "SELECT external_id, 'unparseable event' AS reason FROM raw WHERE id % 211 = 0 OR id % 223 = 0")

# Stored state: clubs id % 4 <> 1, matches id % 10 <> 3. Deliveries: 1 = all
# matches scheduled 0-0, 2 = final state of id % 10 <> 0. New ids follow
# (first delivery, external id) after the stored maximum.
UPSERT_CTES = """
, appear AS (SELECT home_team_id AS tid FROM raw UNION SELECT away_team_id FROM raw),
st_teams AS (SELECT id, external_id, name, short_name, crest_url, primary_color, secondary_color
             FROM teams0 WHERE id % 4 <> 1),
new_teams AS (
  SELECT CAST((SELECT max(id) FROM st_teams) + row_number() OVER (ORDER BY md5(external_id), external_id) AS BIGINT) AS id,
         external_id, name, short_name, crest_url, primary_color, secondary_color
  FROM teams0 WHERE id % 4 = 1 AND id IN (SELECT tid FROM appear)),
up_teams AS (SELECT * FROM st_teams UNION ALL SELECT * FROM new_teams),
tmap AS (SELECT t0.id AS old_id, u.id AS new_id FROM teams0 t0 JOIN up_teams u USING (external_id)),
dl AS (
  SELECT m.id AS orig_id, m.matchweek AS orig_matchweek, m.external_id, m.competition, m.season, m.kicks_off_at,
         CASE WHEN m.id % 10 <> 0 THEN m.status ELSE 'scheduled' END AS status,
         hm.new_id AS home_team_id, am.new_id AS away_team_id,
         CASE WHEN m.id % 10 <> 0 THEN m.home_goals ELSE 0 END AS home_goals,
         CASE WHEN m.id % 10 <> 0 THEN m.away_goals ELSE 0 END AS away_goals,
         CASE WHEN m.id % 10 <> 0 THEN m.minute END AS minute,
         CASE WHEN m.id % 10 <> 0 THEN m.stoppage_minute END AS stoppage_minute
  FROM matches m JOIN tmap hm ON hm.old_id = m.home_team_id JOIN tmap am ON am.old_id = m.away_team_id),
newm AS (SELECT external_id,
                CAST((SELECT max(id) FROM raw WHERE id % 10 <> 3) + row_number() OVER (ORDER BY md5(external_id), external_id) AS BIGINT)
                  AS new_id
         FROM raw WHERE id % 10 = 3),
up_matches AS (
  SELECT coalesce(n.new_id, d.orig_id) AS id, d.external_id, d.competition, d.season,
         CASE WHEN n.new_id IS NULL THEN d.orig_matchweek END AS matchweek,
         d.kicks_off_at, d.status, d.home_team_id, d.away_team_id, d.home_goals, d.away_goals, d.minute,
         d.stoppage_minute, TIMESTAMP '2001-09-01 12:00:00' AS updated_at
  FROM dl d LEFT JOIN newm n USING (external_id)),
fan_u AS (SELECT id, competition, season, kicks_off_at, home_team_id AS team_id FROM up_matches
          WHERE status <> 'cancelled'
          UNION ALL SELECT id, competition, season, kicks_off_at, away_team_id FROM up_matches
          WHERE status <> 'cancelled'),
dmw_u AS (SELECT id, CAST(max(nth) AS INTEGER) AS mw FROM (
            SELECT id, row_number() OVER (PARTITION BY competition, season, team_id ORDER BY kicks_off_at, id) AS nth
            FROM fan_u) x GROUP BY id),
changes AS (SELECT u.id, u.competition, u.season, u.matchweek AS old_matchweek, d.mw AS new_matchweek
            FROM up_matches u JOIN dmw_u d ON d.id = u.id WHERE u.matchweek IS DISTINCT FROM d.mw)"""
ORACLES["upsert_teams"] = with_base(UPSERT_CTES + "\nSELECT * FROM up_teams")
ORACLES["upsert_matches"] = with_base(UPSERT_CTES + "\nSELECT * FROM up_matches")
ORACLES["refresh_matchweeks"] = with_base(UPSERT_CTES + "\nSELECT * FROM changes")
# The same stored state, and the damaged feed's events of 1996 (and those whose
# date does not parse, which the quarantine has to see).
_WINDOW = _FEED + """,
w AS (SELECT * FROM said WHERE no_date OR (kicks_off_at >= TIMESTAMP '1996-01-01' AND kicks_off_at < TIMESTAMP '1997-01-01')),
good AS (SELECT * FROM w WHERE NOT unparseable),
held AS (SELECT id, external_id FROM teams0 WHERE id % 4 <> 1),
named AS (SELECT home_ext AS e FROM good WHERE home_name <> '' UNION SELECT away_ext FROM good WHERE away_name <> ''),
clubs AS (
  SELECT id, external_id FROM held
  UNION ALL
  SELECT CAST((SELECT max(id) FROM held) + row_number() OVER (ORDER BY md5(e), e) AS BIGINT), e
  FROM named WHERE e NOT IN (SELECT external_id FROM held)),
met AS (SELECT g.*, h.id AS hid, a.id AS aid FROM good g LEFT JOIN clubs h ON h.external_id = home_ext
        LEFT JOIN clubs a ON a.external_id = away_ext),
judged AS (SELECT *, CASE WHEN season = 1066 THEN 'season outside 1870-2100' WHEN home_goals < 0 THEN 'goals outside 0-1000' END AS refused
           FROM met WHERE hid IS NOT NULL AND aid IS NOT NULL),
taken AS (SELECT * FROM judged WHERE refused IS NULL),
fresh AS (SELECT external_id, CAST((SELECT max(id) FROM raw WHERE id % 10 <> 3)
                                   + row_number() OVER (ORDER BY md5(external_id), external_id) AS BIGINT) AS new_id
          FROM taken WHERE id % 10 = 3),
state AS (
  SELECT coalesce(f.new_id, t.id) AS id, t.external_id, t.competition, t.season, CASE WHEN f.new_id IS NULL THEN m.matchweek END AS old_week,
         t.kicks_off_at, t.status, t.hid AS home_team_id, t.aid AS away_team_id, t.home_goals, t.away_goals,
         CASE WHEN t.status = 'live' THEN shown_minute END AS minute, CASE WHEN t.status = 'live' THEN shown_stoppage END AS stoppage_minute,
         TIMESTAMP '2001-09-01 12:00:00' AS updated_at
  FROM taken t JOIN matches m ON m.id = t.id LEFT JOIN fresh f ON f.external_id = t.external_id
  UNION ALL
  SELECT id, external_id, competition, season, matchweek, kicks_off_at, status, home_team_id, away_team_id, home_goals, away_goals,
         minute, stoppage_minute, updated_at
  FROM matches WHERE id % 10 <> 3 AND id NOT IN (SELECT id FROM taken)),
touched AS (SELECT DISTINCT competition, season FROM taken),
both_sides AS (SELECT id, competition, season, kicks_off_at, home_team_id AS club FROM state WHERE status <> 'cancelled'
               UNION ALL SELECT id, competition, season, kicks_off_at, away_team_id FROM state WHERE status <> 'cancelled'),
week AS (SELECT id, CAST(max(k) AS INTEGER) AS new_week FROM (
           SELECT id, row_number() OVER (PARTITION BY competition, season, club ORDER BY kicks_off_at, id) AS k
           FROM both_sides JOIN touched USING (competition, season)) GROUP BY id),
done AS (SELECT s.*, coalesce(new_week, old_week) AS matchweek FROM state s LEFT JOIN week ON week.id = s.id),
refusals AS (
  SELECT external_id, 'unparseable event' AS reason FROM w WHERE unparseable
  UNION ALL SELECT external_id, concat('team without a name (team=', home_ext, ')') FROM good WHERE home_name = ''
  UNION ALL SELECT external_id, concat('team without a name (team=', away_ext, ')') FROM good WHERE away_name = ''
  UNION ALL SELECT external_id, concat('unresolved club (home=', home_ext, ' away=', away_ext, ')') FROM met
            WHERE hid IS NULL OR aid IS NULL
  UNION ALL SELECT external_id, refused FROM judged WHERE refused IS NOT NULL)"""
ORACLES["ingest_window"] = with_base(_WINDOW + """
SELECT id, external_id, competition, season, matchweek, kicks_off_at, status, home_team_id, away_team_id, home_goals, away_goals,
       minute, stoppage_minute, updated_at
FROM done""")
# The whole history of the state after the window ingest, of the clubs that it knows.
_AFTER = HISTORY_SQL.replace(" cm ", " cm2 ").replace("JOIN teams t ON t.id = s.team_id", "JOIN club_names t ON t.id = s.team_id")
ORACLES["history_after_ingest"] = with_base(_WINDOW + """,
fan2 AS (SELECT competition, season, matchweek, status, home_team_id AS team_id, home_goals AS goals_for, away_goals AS goals_against FROM done
         UNION ALL SELECT competition, season, matchweek, status, away_team_id, away_goals, home_goals FROM done),
cm2 AS (SELECT *, CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for = goals_against THEN 'D' ELSE 'L' END AS outcome
        FROM fan2 WHERE status = 'finished' AND goals_for IS NOT NULL AND goals_against IS NOT NULL),
club_names AS (SELECT c.id, t.name FROM clubs c JOIN teams0 t USING (external_id))""" + _AFTER + "\nSELECT * FROM ph")
ORACLES["ingest_quarantine"] = with_base(_WINDOW + "\nSELECT * FROM refusals")
ORACLES["ingest_report"] = with_base(UPSERT_CTES + _WINDOW + """
SELECT 'backfill' AS window,
       CAST((SELECT count(*) FROM raw) + (SELECT count(*) FROM raw WHERE id % 10 <> 0) AS BIGINT) AS fetched,
       CAST((SELECT count(*) FROM appear) AS BIGINT) AS teams_upserted,
       CAST((SELECT count(*) FROM raw) + (SELECT count(*) FROM raw WHERE id % 10 <> 0) AS BIGINT) AS matches_upserted,
       CAST((SELECT count(*) FROM changes) AS BIGINT) AS matchweeks_updated,
       CAST(0 AS BIGINT) AS skipped
UNION ALL
SELECT '19960101-19961231', (SELECT count(*) FROM w), (SELECT count(*) FROM named), (SELECT count(*) FROM taken),
       (SELECT count(*) FROM done WHERE matchweek IS DISTINCT FROM old_week), (SELECT count(*) FROM refusals)""")
# Stream: delivery 1 then delivery 2, each followed by a matchweek refresh;
# a match cancelled in delivery 2 keeps the number delivery 1 gave it.
ORACLES["ingest_stream"] = with_base(UPSERT_CTES + """,
fan_1 AS (SELECT id, competition, season, kicks_off_at, home_team_id AS team_id FROM up_matches
          UNION ALL SELECT id, competition, season, kicks_off_at, away_team_id FROM up_matches),
dmw_1 AS (SELECT id, CAST(max(nth) AS INTEGER) AS mw FROM (
            SELECT id, row_number() OVER (PARTITION BY competition, season, team_id ORDER BY kicks_off_at, id) AS nth
            FROM fan_1) x GROUP BY id),
touched_2 AS (SELECT DISTINCT competition, season FROM raw WHERE id % 10 <> 0)
SELECT u.id, u.external_id, u.competition, u.season,
       CASE WHEN t.competition IS NULL OR u.status = 'cancelled' THEN d1.mw ELSE d2.mw END AS matchweek,
       u.kicks_off_at, u.status, u.home_team_id, u.away_team_id, u.home_goals, u.away_goals, u.minute,
       u.stoppage_minute, u.updated_at
FROM up_matches u JOIN dmw_1 d1 ON d1.id = u.id LEFT JOIN dmw_u d2 ON d2.id = u.id
LEFT JOIN touched_2 t ON t.competition = u.competition AND t.season = u.season""")
_SEASON = _WINDOW.replace("1996-01-01", "2000-07-01").replace("1997-01-01", "2001-07-01")
ORACLES["ingest_season"] = with_base(_SEASON + """
SELECT id, external_id, competition, season, matchweek, kicks_off_at, status, home_team_id, away_team_id, home_goals, away_goals,
       minute, stoppage_minute, updated_at
FROM done""")
# Three polls: the first sees all matches as scheduled, the others as they ended,
# some six days later. A match is as the last poll that sees it says.
_POLLED = """
, polls AS (SELECT * FROM (VALUES (1, TIMESTAMP '1997-03-01 04:10:00'), (2, TIMESTAMP '1997-03-08 04:10:00'),
                                  (3, TIMESTAMP '1997-03-15 04:10:00')) p(k, now)),
seen AS (
  SELECT k, now, m.id, m.external_id, m.competition, m.season, m.home_team_id, m.away_team_id,
         CASE WHEN k > 1 AND m.id % 10 = 4 THEN m.kicks_off_at + INTERVAL 6 DAY ELSE m.kicks_off_at END AS kicks_off_at,
         CASE WHEN k = 1 THEN 'scheduled' WHEN m.status = 'cancelled' THEN 'postponed' ELSE m.status END AS status,
         CASE WHEN k = 1 THEN 0 ELSE m.home_goals END AS home_goals, CASE WHEN k = 1 THEN 0 ELSE m.away_goals END AS away_goals,
         CASE WHEN k > 1 THEN m.minute END AS minute, CASE WHEN k > 1 THEN m.stoppage_minute END AS stoppage_minute
  FROM raw m CROSS JOIN polls),
read AS (SELECT * FROM seen WHERE CAST(kicks_off_at AS DATE) BETWEEN CAST(now AS DATE) - 3 AND CAST(now AS DATE) + 10)"""
ORACLES["ingest_recent"] = with_base(_POLLED + """,
newest AS (SELECT *, min(k) OVER (PARTITION BY id) AS first_k FROM read QUALIFY k = max(k) OVER (PARTITION BY id)),
fresh AS (SELECT id, CAST((SELECT max(id) FROM raw WHERE id % 10 <> 3) + row_number() OVER (ORDER BY first_k, md5(external_id)) AS BIGINT) AS new_id
          FROM newest WHERE id % 10 = 3),
state AS (
  SELECT coalesce(new_id, n.id) AS id, n.external_id, n.competition, n.season, CASE WHEN new_id IS NULL THEN m.matchweek END AS old_week,
         n.kicks_off_at, n.status, n.home_team_id, n.away_team_id, n.home_goals, n.away_goals, n.minute, n.stoppage_minute, n.now AS updated_at
  FROM newest n JOIN matches m ON m.id = n.id LEFT JOIN fresh ON fresh.id = n.id
  UNION ALL
  SELECT id, external_id, competition, season, matchweek, kicks_off_at, status, home_team_id, away_team_id, home_goals, away_goals,
         minute, stoppage_minute, updated_at
  FROM matches WHERE id % 10 <> 3 AND id NOT IN (SELECT id FROM newest)),
sides AS (SELECT id, competition, season, kicks_off_at, home_team_id AS club FROM state WHERE status <> 'cancelled'
          UNION ALL SELECT id, competition, season, kicks_off_at, away_team_id FROM state WHERE status <> 'cancelled'),
week AS (SELECT id, CAST(max(k) AS INTEGER) AS new_week FROM (
           SELECT id, row_number() OVER (PARTITION BY competition, season, club ORDER BY kicks_off_at, id) AS k
           FROM sides JOIN (SELECT DISTINCT competition, season FROM read) USING (competition, season)) GROUP BY id)
SELECT s.id, s.external_id, s.competition, s.season, coalesce(new_week, old_week) AS matchweek, s.kicks_off_at, s.status,
       s.home_team_id, s.away_team_id, s.home_goals, s.away_goals, s.minute, s.stoppage_minute, s.updated_at
FROM state s LEFT JOIN week USING (id)""")
ORACLES["poll_windows"] = with_base(_POLLED + """,
clubs AS (SELECT k, count(DISTINCT club) AS n FROM (SELECT k, home_team_id AS club FROM read UNION ALL SELECT k, away_team_id FROM read) GROUP BY k)
SELECT strftime(CAST(now AS DATE) - 3, '%Y%m%d') || '-' || strftime(CAST(now AS DATE) + 10, '%Y%m%d') AS window,
       count(id) AS fetched, coalesce(any_value(n), 0) AS teams_upserted, count(id) AS matches_upserted, CAST(0 AS BIGINT) AS skipped
FROM polls LEFT JOIN (SELECT k, id FROM read) USING (k) LEFT JOIN clubs USING (k) GROUP BY now""")
ORACLES["feed_corrupt"] = with_base("""
SELECT competition, CASE WHEN id % 101 = 0 OR id % 103 = 0 THEN 'unreadable payload' ELSE 'payload with a value of another type' END AS reason,
       external_id AS first_event
FROM raw WHERE id % 101 = 0 OR id % 103 = 0 OR id % 107 = 0
UNION ALL SELECT 'none', 'empty file', NULL""")
ORACLES["club_lookup"] = with_base("""
, asked AS (SELECT id AS request, CASE WHEN id % 3 = 1 THEN concat('no-', slug) ELSE slug END AS slug FROM teams)
SELECT request, asked.slug, t.id AS team_id, t.name
FROM asked LEFT JOIN (SELECT * FROM teams QUALIFY row_number() OVER (PARTITION BY slug ORDER BY id) = 1) t ON t.slug = asked.slug""")
ORACLES["pair_records"] = with_base("""
, clubs AS (SELECT DISTINCT competition, team_id FROM fan),
pairs AS (SELECT competition, team_id AS team_a_id, team_id + d AS team_b_id FROM clubs, (VALUES (1), (2)) v(d))
SELECT p.competition, team_a_id, team_b_id, CAST(count(cm.id) AS INTEGER) AS played,
       CAST(count(*) FILTER (WHERE outcome = 'W') AS INTEGER) AS team_a_wins, CAST(count(*) FILTER (WHERE outcome = 'D') AS INTEGER) AS draws,
       CAST(count(*) FILTER (WHERE outcome = 'L') AS INTEGER) AS team_b_wins, CAST(coalesce(sum(goals_for), 0) AS INTEGER) AS team_a_goals,
       CAST(coalesce(sum(goals_against), 0) AS INTEGER) AS team_b_goals
FROM pairs p LEFT JOIN cm ON cm.competition = p.competition AND cm.team_id = team_a_id AND cm.opponent_id = team_b_id
GROUP BY p.competition, team_a_id, team_b_id""")
ORACLES["view_requests"] = with_base("""
, rq AS (
  SELECT id, competition,
         CASE id % 6 WHEN 0 THEN CAST(season AS VARCHAR) WHEN 1 THEN 'abc' WHEN 2 THEN '2000'
                     WHEN 3 THEN CAST(season AS VARCHAR) || '.5' WHEN 5 THEN ' 2001 ' END AS season_raw,
         CASE id % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'home' WHEN 2 THEN 'away' WHEN 3 THEN 'HOME' END AS venue_raw,
         CASE id % 7 WHEN 0 THEN '6' WHEN 1 THEN '0' WHEN 2 THEN '45' WHEN 3 THEN '-3' WHEN 4 THEN 'x'
                     WHEN 6 THEN '12' END AS last_raw,
         CASE id % 4 WHEN 0 THEN 'top6' WHEN 1 THEN 'bottom-half' WHEN 2 THEN 'all' ELSE 'top3' END AS opponents_raw,
         CASE id % 12 WHEN 0 THEN 'position' WHEN 1 THEN 'name' WHEN 2 THEN 'played' WHEN 3 THEN 'won'
                      WHEN 4 THEN 'drawn' WHEN 5 THEN 'lost' WHEN 6 THEN 'goalsFor' WHEN 7 THEN 'goalsAgainst'
                      WHEN 8 THEN 'goalDifference' WHEN 9 THEN 'points' WHEN 10 THEN 'drop table teams' END AS sort_raw,
         CASE id % 3 WHEN 0 THEN 'asc' WHEN 1 THEN 'desc' ELSE 'DESC' END AS dir_raw
  FROM matches),
dflt AS (SELECT competition, coalesce(max(season) FILTER (WHERE status = 'finished'), 2025) AS d
         FROM matches GROUP BY competition),
num AS (SELECT rq.*, dflt.d,
               CASE WHEN trim(season_raw) = '' THEN 0.0
                    WHEN regexp_full_match(trim(season_raw), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
                    THEN TRY_CAST(trim(season_raw) AS DOUBLE) END AS n
        FROM rq LEFT JOIN dflt USING (competition))
SELECT id, competition,
       CASE WHEN n IS NOT NULL AND n = floor(n) AND n BETWEEN 2000 AND 2100 THEN CAST(n AS INTEGER)
            ELSE CAST(d AS INTEGER) END AS season,
       CASE WHEN venue_raw IN ('all', 'home', 'away') THEN venue_raw ELSE 'all' END AS venue,
       CASE WHEN regexp_full_match(last_raw, '\\d+') AND least(38, CAST(last_raw AS DOUBLE)) > 0
            THEN CAST(least(38, CAST(last_raw AS DOUBLE)) AS INTEGER) END AS last_n,
       CASE WHEN opponents_raw IN ('all', 'top6', 'bottom-half') THEN opponents_raw ELSE 'all' END AS opponents,
       CASE WHEN sort_raw IN ('position', 'name', 'played', 'won', 'drawn', 'lost', 'goalsFor', 'goalsAgainst',
                              'goalDifference', 'points') THEN sort_raw ELSE 'position' END AS sort,
       CASE WHEN dir_raw = 'desc' THEN 'desc' ELSE 'asc' END AS direction
FROM num""")
