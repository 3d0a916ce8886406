"""The small labelled table from which the tagger of personal data is trained.

All of it is invented: contexts with slots for personal data ({N} name, {E}
e-mail, {P} phone, {I} identifier, {A} postal address), contexts of random
common words ({w}), so that a name may stand anywhere, labels, signatures, and
sentences without personal data that look as if they held some. The slots are
filled with invented values of many forms.
"""

from __future__ import annotations

import random
import re

# Contexts that hold personal data.
WITH = """{N} chaired the panel and took notes.
During the rehearsal {N} pointed at slide four.
We met {N} and {N} at a summer school.
I was told by {N} that the server room had flooded.
My supervisor {N} has since moved to industry.
Professor {N} and Dr. {N} share the grant.
Mr. {N}, Mrs. {N} and Ms. {N} signed the protocol.
{N}, who maintains the repository, answered within a day.
The acknowledgement names {N}, {N} and {N} as testers.
A screenshot in the supplement displays the desktop of {N}.
File properties list {N} as owner and {E} as account.
For the keys ask {N} ({E}).
Drop me a line: {E}
{E} is the address to use.
Send corrections to {E}, not to the list.
Logs may be requested from {E} or {E}.
Ring {P} between nine and five.
In urgent cases dial {P} and ask for {N}.
Voicemail: {P}; mobile: {P}.
The hotline {P} was printed on the poster.
A label on the box reads {A}.
Deliveries go to {A}, attention {N}.
Our lab moved to {A} in spring.
He still lives at {A} with two cats.
Come to {A} and bring the forms.
One subject, {N}, born in Lyon, residing at {A}, withdrew.
Badge {I} opened the cabinet at night.
Employee {I} labelled most of the images.
Her passport, number {I}, is visible on page three.
His social security number {I} must be blacked out.
The log was uploaded under {I} last June.
See the profile {I} for earlier reports.
Researcher {N} ({I}) declares no interests.
National identity number {I} appears in column two.
User {I} posted the same text twice.
Signed, {N}, {A}
This note is by {N}.
Yours, {N}
- {N}, reviewer two
PS: {N} asked me to mention this.
Frau {N} und Herr {N} haben zugestimmt.
Bitte melden Sie sich bei {N}, Telefon {P}.
Die Proben lagern bei {N} in {A}.
Schreiben Sie an {E}, danke.
Das Formular trägt den Namen {N} und die Nummer {I}.
Unser Büro: {A}.
Contactez {N} au {P}, merci.
Mme {N} et M. {N} ont relu le manuscrit.
Nos locaux se trouvent {A}.
Une copie a été envoyée à {E} hier.
Pregunten por {N} en el {P}.
La doctora {N} vive en {A}.
Su correo es {E} y su pasaporte {I}.
O responsável é {N}, telefone {P}.
Il referente è {N}, {E}.
Спросите у {N} или позвоните: {P}.
Ответственный исполнитель {N}, почта {E}.
Паспорт {I} принадлежит сотруднику {N}.
Мой адрес: {A}.
김 간사 대신 {N} 님께 연락 바랍니다.
{N} 선생님이 초안을 검토하셨다.
발표는 {N} 교수, 기록은 {N} 박사가 맡았다.
{N}에게 {E} 주소로 보내 주세요.
{N}의 사번은 {I}이다.
제 번호는 {P}이고 사무실은 {A}입니다.
택배는 {A}(으)로 보내면 된다.
{N}은 이 결과를 이미 알고 있었다.
设备由{N}老师负责，电话{P}。
请把样品寄到{A}，收件人{N}。
{N}和{N}参加了讨论。
他的护照号码为{I}，请删除。
有问题发邮件到{E}即可。
{N}さんに{E}までご連絡ください。
担当の{N}は{P}で待機している。
送付先は{A}です。
{N}先生の職員番号は{I}だった。
راسلوا {N} على {E} من فضلكم.
رقم الهاتف {P}.
{N} से {P} पर बात करें।
पता: {A}
โทร {P} หรืออีเมล {E}
{w} {w} {N} {w} {w} {w}.
{w} {w} {w} {N}, {w} {w}.
{w} {N} {w} {N} {w} {w}.
{w} {w} ({N}) {w} {w}.
{w} {w} {E} {w} {w}.
{w} {E}, {w} {w} {w}.
{w} {w} {P} {w} {w}.
{w} {w} {w} {A}, {w} {w}.
{w} {w} {A}.
{N} {w} {w} {w} {w} {w} {P}.
{N} {w} {A} {w} {w} {E}.
{w} {w} {w} number {I} {w} {w}.
{w} {w} {w} account {I} {w}.
{w} {w} record {I}, {w} {w}.
{w} passport {I} {w} {w} {w}.
{W} {N} {w} {w} at {E}, {w} {w}.
{W} {w} {P}, {w} {w} {w}.
{W} {w} {w} on {P} {w}; {w} {w}.
{W} {P} {w} {E}.
{W} {E} {w} {P}.
{W} {w} to {N}, {A}, {w} {w}.
{W} {w} {w} {I} {w} to {N}.
{W} {w} {w} {w} {I}.
{W} {N} {w} {w}, {N} {w} {w}.
{W} as {N} {w}, {w} {w}.
{W} {w} of {N} {w} {w}.
{W} {w} is {N}.
{W} am {N} {w} {w}.
{N} and {N} {w} {w} the {w}.
({N} {w} {w} {E}.)
({w} {P})
{N}, {E}, {w} {w}
{h} {N} {h}다.
{h} {N} 씨가 {h} {h}.
{h} {N} 박사가 {h} {h}.
{h} {N} 연구원이 {h} {h}.
{h} {N} 연구원({E}){h} {h}.
{h} {N} 책임 {h} {P}.
{h} {N} 대리와 {N} 과장이 {h}.
{h} {N} 팀장은 {h} {h}.
{h} {N}과 {N}이 {h} {h}.
As {N} {w}, {w} {w} {w}.
As {N} {w} {w} at the {w} {w}, the {w} {w}.
I am {N}, {w} {w}.
I am {N} and I {w} {w} {w}.
{W} {w} subject {N}, {w} {I}, {w} {w}.
{W} {w} person {N}, code {I}, {w} at {A}.
({N} {w} {w} {w} {w} {w}.)
{W} {w} {w} {w} {w} {N}, {w} {w} the {w}.
{W} {w} {w} by my {w} {N}, who {w} the {w}.
{W} {w} {w} to {N}, {A}, last {w}.
{W} {N}, {N} and {N}.
{W} {w} of {N} and {N} {w} {w} {w}!
{W} {w} next to {N}. {W} {w} {w}.
Kindly contact {N} at {E}.
{W} contact {N} at {P} {w} {w}.
{W} contact {N}, {w} {w}.
{W} reach {N} on {P} {w} {w}.
{W} {w} thanks {N} for {w} {w}.
{W} {w} email {N} ({E}).
{N} {w} the {w} {w}.
{N} {w} {w} to {w} the {w}.
{W} {w}: {N} {w}, {N} {w} {w}.
{W} {N} ({E}) {w} {w} {w}.
{h}由{N}{h}，{h}{h}。
{h}{h}写有{N}的{h}号{I}。
{W} {w} can {w} {w} to {A} {w} {w}.
{h} {N} {h} {A} {h}.
{h} {h}은 {N} 교수가 {h}.
{h} {N}의 {h}은 {I}로 {h}.
{W} {w} {N} {w} {P} {w} {w} {w}.
{W} {w} {P}; {w} {w} {w} {w} {A}.
{W} {w} {w} {w} {w} {P} {w} {w} {w}.
{W} {w} {w} {P} or {w} {w} {w} {w} {E}.
{W} ({E}, {P}) {w} {w} {w}.
{W} {N} ({E}, {P}) {w} {w}.
{W} {N} and {N} {w} the {w}!
{W} to Prof. {N} and {N} {w} the {w}.
{W} {w} {w} {w} {E}.
{W} {w} {A}, and {N} {w} the {w}.
{W} {w} {N}, {w} {I}, {w} at {A}.
{W} {w} {w} is {I} {w} {w} the {w}.
{W} {w} {w} {w} from {A}.
{h}{h}{N}的{h}{h}{I}{h}。
{h}{h}在{A}。
{h}{N}，{h}{h}{E}。
{h} {h} {N} {h} {h} {E}.
{h} {N} 연구자는 {h}.
{h} {N}의 {h} {I} {h}.
{h} {E}로 {h}.
{h} {N}({E})에게 {h}.
{h} {A}에 {h}.
{h} {P} {h}니다.
참가자 {N}, 번호 {I}, {h}.
작성자는 {N}이며 {h} {h}.
{h}{h}{N}的{h}{I}。
{h}{h}{E}。
{h}联系{N}，{h}{E}。
{h}{h}{A}，{h}{h}。
{h}{h}电话{P}。
{N}先生{h}{h}，{h}{h}。
感谢{N}和{N}的{h}{h}。
{h}{h}は{N}です。
{h}{N}（{E}）に{h}{h}。
{h}は{A}に{h}{h}。
{h}{h}は{P}です。
{h}{N}氏が{h}{h}した。
Я {N}, {h} {h}.
{h} {N} {h} {h} {E}.
{h} {h}: {P}.
Спасибо {N} за {h}.
Merci à {N} pour {h}.
J'habite {A}, {h} {h}.
Ich bin {N} und {h} {h}.
Dank an {N} für {h}.
Soy {N}, {h} {h}.
Gracias a {N} por {h}, {I}.
{w} {w} {N}, {I}, {w}.""".splitlines()

# Labels before values, by kind of value.
LABELS = {
    "N": "Contact;담당자;담당;연구자;Contact person;Name;Author;Lead;Lead author;Supervisor;Principal investigator;PI;Corresponding author;Submitted by;Attn;담당;담당자;성명;이름;책임자;연구책임자;姓名;联系人;负责人;氏名;担当;責任者;Ansprechpartner;Nom;Responsable;Имя;Руководитель".split(";"),
    "E": "E-mail;Email;Mail;e-mail;메일;이메일;邮箱;メール;Courriel;Correo;Почта".split(";"),
    "P": "Tel;Tel.;Phone;Mobile;Fax;T;☎;전화;연락처;휴대폰;电话;電話;Telefon;Tél;Teléfono;Телефон".split(";"),
    "I": "ID;ID no.;Staff no.;Staff ID;Badge;Passport;SSN;ORCID;Employee;Researcher ID;등록번호;사번;여권번호;주민번호;证件号;工号;社員番号;Ausweis;DNI;Паспорт".split(";"),
    "A": "Address;Postal address;Mail to;Office;주소;地址;住所;Anschrift;Adresse;Dirección;Адрес".split(";"),
}

# Sentences without personal data; {T} technical name, {L} name of a method's author, {Y} year, {D} number.
WITHOUT = """{T} beats {T} by {D} on the held-out fold.
We train {T}-{d} for {D} steps with a batch of {d}.
Following {L} et al. ({Y}), the loss is clipped at {D}.
As shown before ({L} and {L}, {Y}), {T} diverges.
({L} et al., {Y}; {L}, {Y}) report the opposite.
{L} ({Y}) proves a tighter bound.
The {L} distance is larger than the {L} norm.
{L}'s theorem needs convexity.
The {L} and {L} estimators agree.
A {L} process with {L}-type kernels is enough.
Trained on an A{d} with {d} GB, {T} takes {D} hours.
The {C} corpus has {D} sentences, {C} has {D}.
Data come from {C} City, the {C} Valley and {C} River stations.
{T} Inc. sells {T}, and {T} GmbH resells it.
Eq. ({d}), Fig. {d} and Tab. {d} disagree; see pp. {d}-{d}.
Version v{d}.{d}.{d} was tagged on {Y}-0{d}-1{d}.
The range {D}-{D} is wider than [{D}, {D}].
DOI 10.{d}{d}{d}{d}/{w}.{Y}.{d}{d} is broken.
Commit {h} and {h} both fail.
Layers of {d}{d}-{d}{d}-{d}{d} units, seeds {d}{d}{d}, {d}{d}{d} and {d}{d}{d}{d}{d}{d}{d}{d}.
We keep {d}000-{d}000-{d}000 samples per split.
Access was checked at {d}:{d}0 on {Y}/0{d}/0{d}.
Mentions of @{w}, @{w}-{w} and recall@{d} are parsed.
The placeholder [EMAIL] and the tag [NAME] remain.
Write to [EMAIL] or call [PHONE]; [ADDRESS] is masked.
IDs such as {T}-{d}{d} or S{d} mark samples, not people.
Grant totals of {D},{d}{d}{d} and {D},{d}{d}{d} are equal.
Is {T} better than {T}? We doubt it.
# {T}: a plan for {w} {w}
## {d}. {W} and {w}
**{W}**
{W}:
{W} {w}
Dear authors, thank you for the revision.
Dear colleagues,
Strong points: {w}, {w} and {w}.
In the U.S. and the E.U. rules differ, e.g. for {w}.
{W} {w} {w} {w} {w} {w}.
{W} {w}, {w} {w} {w}, {w} {w}.
{W} {w} {w} {T} {w} {w} {T}.
{W} {T} {w} {w} {D} {w}.
{w} {w} {C} {w} {w} {C} {w}.
Das Modell {T} ist im Vergleich zu {T} zu langsam.
Wie {L} et al. ({Y}) zeigen, gilt das nur für {D} % der Fälle.
Die Abbildung {d} und die Tabelle {d} fehlen.
Le modèle {T} atteint {D} % sur {C}.
Selon {L} ({Y}), la borne est fausse.
El método {T} no mejora a {T} en {C}.
Los valores de {D} a {D} no tienen sentido.
Модель {T} не превосходит {T} на {C}.
Как показано в работе ({L}, {Y}), прирост равен {D}.
Набор данных {C} слишком мал, а таблица {d} неполна.
본 과제는 {T} 모형을 {C} 자료에 적용한다.
{L} 외({Y})는 {D}의 오차를 보고하였다.
표 {d}과 그림 {d}의 수치가 서로 다르다.
실험 설계와 평가 지표를 다시 정리해야 한다.
연구 목표는 재현 가능한 분석 절차를 만드는 것이다.
데이터 수집 방법이 분명하지 않고 한계가 크다.
참고 문헌과 부록의 번호가 맞지 않습니다.
작년 대비 {D}% 늘었으나 이유는 설명되지 않았다.
如{L}等（{Y}）所述，{T}的误差为{D}。
表{d}的数字与图{d}不一致。
作者应当说明数据来源和评价指标。
该方法在{C}数据上没有优势，实验也不完整。
{L}ら（{Y}）によれば、{T}の誤差は{D}である。
表{d}と図{d}の値が一致しない。
実験の設定と評価の指標を説明してほしい。
この手法は新しいとは言えないが、興味深い。
نتائج {T} على {C} ضعيفة.
الجدول {d} غير واضح ويحتاج إلى شرح.
{T} के परिणाम {C} पर कमज़ोर हैं।
तालिका {d} में त्रुटि है।
ผลของ {T} บน {C} ไม่ชัดเจน
ตารางที่ {d} ควรแก้ไข
{h}{h}{h}，{h}{h}{h}{h}。
{h}{h}{h}{h}{h}{h}{h}。
{h}{h}{T}{h}{h}，{h}{h}为{D}。
{h}{h}的{h}{h}是{h}{h}，不{h}{h}。
“{h}{h}{h}。{h}{h}”，{h}{h}没有{h}。
{h}{h}は{h}{h}であり、{h}{h}である。
{h}の{h}{h}を{h}{h}してください。
{h}{T}{h}は{D}で、{h}{h}はない。
「{h}{h}{h}。」と{h}{h}が{h}ました。
{h} {h} {h} {h}다.
{h} {h} {T} {h} {h} {h}습니다.
{h} {h} {D} {h} {h}니다!
{h} 결과가 {h} {h}?
{h}: {h} {h}, {h}.
## {d}. {h} {h}
# {h} {h} {d}: {T} {h} {h}
**{h} {h}**
As far as I {w} {w}, {w} {w} {w}.
"{h} {h}." {h} {h}라고 {h}.
I {w} {w} {w} {T} {w} {w}.
{W} {w} w.r.t. {T} {w} {w}, i.e. {w}, e.g. {T} or cf. {T}.
{W} {w} w.r.t. {w} {w} {w}; the {w} vs. {T} {w}.
{W} {w}, etc., {w} {w} approx. {D} {w}.
{T} {w}, p. ej. {w} {w}, según {L} ({Y}).
{T} {w}, z. B. {w} {w} und u. a. {w}, d. h. {w}.
{T}, т. е. {h} {h}, и т. д.
{W} {w} {w} {w} on {T}, {w} {w}; {w} {w} {w} {w}.
{W} {W} {w} {w} {w} {w}.
{h} {T}(은)는 {h} {h} {h}.
{h} {h}인 {T}(이)가 {h} {h}.
{h} {h}에서 {D}의 {h} {h}.
{h}，{h}在{T}上的{h}{h}，{h}{h}仅为{D}。
{h}{h}（{h}v{d}.{d}.{d}），{h}{h}！
{h}{h}与{T}{h}{h}？
I am {w} {w} {w} {w}.
As I {w}, the {w} of {T} is {w} {w}.
Thanks for the {w} {w} and the {w}.
The {W} {w} and the {W} {w} are {w}.
Are the {w} of {T} i.i.d. or not?
The {w} of "{w} {w}. {w} {w}." is {w}.
On {C} the {w} is {D} {w} ({w} {d}).
- {w} {w}: {w} {w} {D}
• {W} {w} {T} {w}
{d}) {W} {w} {w}.
Why does {w} {w} {w} from {D} to {D}?
{W} {w} {w} {Y}, {w} {D} {w} {d} {w} {D}.
The code {h} at line {d}{d}{d} {w} {w}.""".splitlines()

# Closings of letters.
CLOSINGS = ["Best,", "Best regards,", "Kind regards", "Thanks,", "Sincerely,", "All the best,", "Cheers,", "Regards,", "Viele Grüße", "Mit freundlichen Grüßen", "Cordialement,", "Saludos,", "С уважением,", "감사합니다.", "드림", "此致", "敬具"]

# Given and family names in use in many places.
GIVEN = "Anna Maria Lena Sofia Emma Olga Ines Clara Nadia Leila Fatima Aisha Priya Ananya Mei Yuki Hana Linh Thuy Amara Ngozi Zola Carmen Lucia Elif Zeynep Katya Petra Ingrid Astrid James Peter Thomas Daniel Lukas Jonas Pierre Louis Diego Mateo Omar Yusuf Ravi Arjun Wei Jun Kenji Hiroshi Minh Kofi Kwame Ivan Dmitri Pavel Lars Sven Bjorn Marco Paolo Emre Mehmet Noah".split()
FAMILY = "Smith Brown Taylor Clark Walker Hughes Keller Fischer Schmidt Weber Wagner Dubois Moreau Lefevre Garcia Lopez Fernandez Silva Santos Costa Rossi Bianchi Ferrari Novak Kowalski Nowak Horvat Ivanova Petrov Sokolova Hansen Larsson Nilsson Virtanen Yilmaz Demir Haddad Mansour Okafor Mensah Diallo Nguyen Tran Tanaka Suzuki Sato Kimura Chen Zhang Huang Patel Sharma Gupta Reddy Cohen Levi Murphy Campbell".split()
_ONSETS, _NUCLEI, _CODAS = "b c d f g h j k l m n p r s t v w z br dr gr kr tr sk st th sh ch".split(), "a e i o u ai ei ou y".split(), "n r l s m nd rt lk".split()
_FAMILY_ENDS = "son sen berg mann ski sky ova ov eva ev ic itch ez es elli etti ini ault eau ier oux ton ley ford worth wood stein feld bach moto yama kawa guchi nen ainen oglu ian escu ides poulos wala kar vold gard dal quist strom man er".split()
# Korean and Chinese family names, Japanese ones, and signs of given names.
HANGUL_FAMILY = "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 홍 전 고 문 손 양 배 백 허 유 남 심 노 하 곽 성 차 주 우 구 나 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 왕 금 옥 육 인 맹 제 모 탁 국 어 은 편 용 예 봉 묘 갈 빙 탄 황보 남궁 제갈 선우 독고".split()
HANGUL = "가 경 규 기 나 다 담 도 동 라 람 래 린 민 바 범 보 빈 상 새 서 석 선 설 성 세 소 솔 수 숙 슬 승 시 아 안 연 영 예 온 용 우 원 유 윤 율 은 이 인 일 재 정 제 종 주 준 지 진 찬 채 철 태 하 한 해 현 혜 호 홍 화 환 훈 휘 희 늘 찬 달 빛 결 별 샘 봄 움".split()
HAN_FAMILY = "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 梁 宋 郑 谢 韩 唐 冯 于 董 萧 程 曹 袁 邓 许 傅 沈 曾 彭 吕 欧阳 上官 司马 诸葛 夏侯 东方 皇甫 尉迟 公孙 慕容 令狐 闻人 东郭 澹台".split()
HAN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂文辉玲宇欣怡浩然子轩雨泽梓涵诗琪嘉俊晨曦若思远清云舟雪月星河岚墨竹松柏影笙砚眠栀"
KANJI_FAMILY = "佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田 松本 井上 木村 清水 森 池田 橋本 石川 前田 藤田 岡田 長谷川 村上 近藤 石井 坂本 遠藤 青木 西村 月岡 霧島 雨宮 鏡味 一条 小鳥遊 八神 水無瀬".split()
KANJI = "太郎 花子 健 翔 蓮 陽菜 美咲 大輔 直樹 恵子 由美 さくら ひかり みのり かなで しおり 拓海 和也 真央 千尋 涼 楓 葵 悠斗 燈 澪 しずく 一輝".split()
SLAVIC_GIVEN = "Иван Пётр Сергей Дмитрий Алексей Николай Тимофей Богдан Мирон Анна Мария Ольга Елена Татьяна Нина Вера Ярослава Людмила Зоя Велимира".split()
SLAVIC_ROOT = "Кузнец Попов Лебед Соловь Медвед Зареч Остров Берёз Дубров Квас Озер Снеж Калин Верхолан Синиц Громов Ветр Полян".split()
ARABIC = "ليلى حسن|سامي الخطيب|نور الدين قاسم|هدى منصور|يوسف العلي".split("|")
HINDI = "अनिता शर्मा|रवि वर्मा|मीरा जोशी|संजय गुप्ता|कविता राव".split("|")
STREETS = "Street St Road Rd Lane Avenue Ave Way Close Square Drive Court Terrace Boulevard Parkway Crescent".split()
TOWNS = "Falls Hill Bay Creek Springs Heights Harbour Bridge Park".split()
WORDS = "model data result method paper review work table claim proof test score value sample figure section author reader error noise rate time study field group case part point number level line order form kind type use need take make give show find keep read write seem appear become remain hold large small clear hard new old good poor main only very quite rather also often never always".split()


def _common(codec: str, first: int, last: int) -> list[str]:
    """The signs in common use that a national character set lists in its rows ``first`` to ``last``."""
    return [c for row in range(first, last + 1) for cell in range(0xA1, 0xFF) if len(c := bytes([row, cell]).decode(codec, "ignore")) == 1]


#: Signs of running text by script: those of the national sets' first levels, and kana.
SIGNS = {"zh": _common("gb2312", 0xB0, 0xD7), "ja": _common("euc_jp", 0xB0, 0xCF) + list("あいうえおかきくけこさしすせそたちつてとなにのはひふへほまみもやゆよらりるれろわをんがぎぐげござじずだでどばびぶべぼ") * 60, "ko": _common("euc_kr", 0xB0, 0xC8)}
# Common nouns and verbs of reports by script, many of which begin as family names do.
COMMON = {
    "ko": "기준 방안 방법 구성 조건 성능 지표 표본 정확도 이론 장점 한계 안정성 신뢰도 오차 임의 유의 전체 주요 차이 추정 현재 함수 저자 독자 심사 과제 연구 목표 배경 목적 접근 자료 검증 계획 활용 실험 결과 분석 모형 모델 학습 평가 절차 근거 주장 비교 설명 문헌 부록 그림 수치 비율 범위 원인 문제 해결 제안 개선 적용 조사 정리 서론 결론 논의 의견 질문 답변 수정 보완 설계 변수 집단 시험 시간 비용 예산 일정 인력 장비 환경 시스템 코드 버전 공개 재현 가능 부족 필요 중요 명확 타당 최신 기존 다양 일반화 표준 편차 평균 분할 조정 기여 독창성 강점 약점 요약 총평 초안 전반 양식 고려 선행 공정 도구 여부 이유 진행 허용 변경 있음 없음 있다 없다 같다 다르다 많다 적다 크다 작다 달라지다 커지다 늘어나다 줄어들다 나타나다 보이다 어렵다 쉽다 그러나 또한 다만 매우 가장 모든 여러 다른 같은 아직 이미".split(),
    "zh": "方法 数据 结果 实验 分析 模型 训练 评价 指标 误差 论文 作者 审稿 问题 说明 图表 章节 附录 文献 基线 比较 证明 假设 定义 公式 参数 样本 分布 显著 性能 提升 下降 代码 版本 公开 复现 创新 贡献 不足 优点 缺点 建议 修改 补充 讨论 结论 摘要 引言 任务 领域 预测 分类 检测 生成 优化 收敛 稳定 效率 时间 成本 条件 范围 标准 平均 方差 比例 来源 质量 噪声 标签 划分 泄漏 对照 消融 可信 充分 清晰 有限 合理 必要 重要 难以 无法 没有 本文 本研究 总体 此外 然而 因此 如果 为什么 是否 应当 可以 希望 进行 提出 采用 报告 表明 给出 解决 关于 由于".split(),
    "ja": "方法 結果 実験 分析 学習 評価 指標 誤差 論文 著者 査読 問題 説明 図表 付録 文献 比較 証明 仮定 定義 数式 標本 分布 有意 性能 向上 低下 公開 再現性 新規性 貢献 限界 長所 短所 提案 修正 補足 議論 結論 要旨 課題 分野 予測 分類 検出 生成 最適化 収束 安定 効率 時間 費用 条件 範囲 標準 平均 分散 割合 品質 雑音 分割 根拠 十分 明確 必要 重要 疑問 全体 しかし また なぜ 本研究 手法 既存 検証 資料 データ モデル コード ベースライン パラメータ テスト スコア".split(),
}
SUFFIXES = "성 적 화 법 률 도 별 식 형 선 점 량 값 치 자 들 상 내 간".split()
PARTICLES = "은 는 이 가 을 를 의 에 로 와 과 도 만 에서 으로 하고 하며 한다 했다 이다 입니다".split()


class Filler:
    """Values for slots, from one random sequence; ``words`` are common words of running text in alphabetic scripts."""

    def __init__(self, r: random.Random, words: list[str]) -> None:
        self.r = r
        self.words = [w for w in words if w < "\u0250"] or WORDS
        self.cyrillic = [w for w in words if "\u0400" <= w[0] < "\u0530"]
        self.rate = 0.0

    def hidden(self, script: str) -> str:
        """A random word of a script: one in common use, or any signs."""
        if script in COMMON and self.r.random() < 0.7:
            return self.pick(COMMON[script]) + (self.pick(["", "", "", *SUFFIXES]) + self.pick([*PARTICLES, "인", "된", "", "", ""]) if script == "ko" else self.pick(["", "", "の", "は", "を", "が"]) if script == "ja" else self.pick(["", "", "", "的"]))
        if script == "ko":
            return "".join(self.pick(SIGNS["ko"]) for _ in range(self.r.randint(1, 3))) + self.pick([*PARTICLES, "", "", ""])
        if script in SIGNS:
            return "".join(self.pick(SIGNS[script]) for _ in range(self.r.randint(1, 3)))
        return self.pick(self.cyrillic if script == "ru" and self.cyrillic else self.words)

    def shaken(self, text: str, script: str) -> str:
        """A piece of a context in which some words are random ones, so that no single word is relied on."""
        if not self.rate:
            return text
        if script in ("zh", "ja"):
            return "".join(self.pick(SIGNS[script]) if "぀" <= c <= "鿿" and self.r.random() < self.rate / 2 else c for c in text)

        def other(m: re.Match) -> str:
            if self.r.random() >= self.rate:
                return m[0]
            w = self.hidden("ko" if "가" <= m[0][0] <= "힣" else "ru" if "А" <= m[0][0] <= "я" else "en" if m[0][0] < "\u0250" else "")
            return w.capitalize() if m[0][0].isupper() else w

        return re.sub(r"[^\W\d_]{3,}" if script != "ko" else r"[가-힣]{2,}(?= )|[A-Za-z]{3,}", other, text)

    def pick(self, options, weights: list[float] | None = None):
        return self.r.choices(options, weights)[0] if weights else self.r.choice(options)

    def sound(self, least: int = 1, most: int = 2) -> str:
        return "".join(self.pick(_ONSETS) + self.pick(_NUCLEI) + (self.pick(_CODAS) if self.r.random() < 0.3 else "") for _ in range(self.r.randint(least, most)))

    def given(self) -> str:
        return self.pick(GIVEN) if self.r.random() < 0.35 else (self.sound() + self.pick(["a", "e", "en", "in", "is", "o", "us", "an", ""])).capitalize()

    def family(self) -> str:
        w = self.pick(FAMILY) if self.r.random() < 0.3 else (self.sound() + self.pick(_FAMILY_ENDS)).capitalize()
        other = self.sound().capitalize()
        return self.pick([w, f"de {w}", f"de la {w}", f"van {w}", f"van den {w}", f"von {w}", f"O'{w}", f"Mc{w}", f"{w}-{other}", f"al-{w}", f"{w} {other}"], [14, 0.7, 1, 0.7, 1, 1, 1.2, 0.5, 1.8, 0.5, 1])

    def name(self, script: str) -> str:
        r = self.r
        if script == "ko" and r.random() < 0.8:
            return self.pick(HANGUL_FAMILY) + "".join(self.pick(HANGUL) for _ in range(self.pick([1, 2, 2, 2, 2, 3])))
        if script == "zh" and r.random() < 0.8:
            return self.pick(HAN_FAMILY) + "".join(self.pick(HAN) for _ in range(self.pick([1, 2, 2])))
        if script == "ja" and r.random() < 0.8:
            return self.pick(KANJI_FAMILY) + self.pick(["", "", " "]) + self.pick(KANJI)
        if script == "ru" and r.random() < 0.8:
            root = self.pick(SLAVIC_ROOT)
            end = self.pick(["ов", "ова", "ин", "ина", "ский", "ская", "ову", "овой", "ину", "иной", "енко"])
            return f"{self.pick(SLAVIC_GIVEN)} {root}{end}" + (f"-{self.pick(SLAVIC_ROOT)}" if r.random() < 0.1 else "")
        if script == "ar" and r.random() < 0.7:
            return self.pick(ARABIC)
        if script == "hi" and r.random() < 0.7:
            return self.pick(HINDI)
        first, last = self.given(), self.family()
        a, b = self.pick("ABCDEFGHIJKLMNOPRSTVW"), self.pick("ABCDEFGHIJKLMNOPRSTVW")
        return self.pick([f"{first} {last}", f"{last}, {first}", f"{first} {last}".upper(), f"{first} {last}".lower(), f"{a}. {last}", f"{a}. {b}. {last}", f"{first} {a}. {last}", f"{first} {self.given()} {last}", f"{first}-{self.given()} {last}"], [10, 2, 1.5, 1.5, 1.3, 0.5, 1.2, 1, 0.6])

    def email(self) -> str:
        a, b = self.sound(), self.sound() + self.pick(_FAMILY_ENDS)
        n = str(self.r.randint(1, 99))
        user = self.pick([f"{a}.{b}", f"{a[0]}{b}", f"{a[0]}.{b}", f"{a}-{b}", f"{a}_{b}", f"{b}{n}", f"{b}_{n}", f"{a}+{b}", a])
        host = self.pick([self.sound(2, 3), f"mail.{self.sound()}", f"cs.{self.sound(2, 2)}", f"uni-{self.sound()}", f"{self.sound()}-{self.sound()}", f"lab.{self.sound()}.ac"]) + "." + self.pick("com org net edu io de fr kr jp ru cn example test invalid co.uk ac.kr".split())
        style = self.pick(range(7), [10, 1, 1, 1, 1, 1, 1])
        return [f"{user}@{host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} (at) {host}", f"{user} AT {host.replace('.', ' DOT ')}", f"{user}＠{host}", f"{user}@{host}".upper(), f"{user}[at]{host}"][style]

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "#" else self.pick("ABCDEFGHJKLMNPRSTWXYZ") if c == "@" else c for c in form)

    def phone(self) -> str:
        p = self.digits(self.pick("+44 7### ######|+44 20 #### ####|07### ### ###|07### ######|020 #### ####|(###) ###-####|###-###-####|###.###.####|### ### ####|1 800 #######|1-800-###-####|###-####|+1 ### ### ####|+1-###-###-####|+1 (###) ###-####|+33 1 ## ## ## ##|0# ## ## ## ##|+49 (0)## ##### ###|+49 ## #######|0## ########|(0##) ### ## ##|010-####-####|010 #### ####|+82-10-####-####|02-###-####|02-####-####|031-###-####|+7 ### ###-##-##|8 (###) ###-##-##|+81 3 #### ####|03-####-####|090-####-####|1## #### ####|+86 1## #### ####|+34 ### ### ###|+39 ## #### ####|+91 ##### #####".split("|")))
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() or c == "-" else c for c in p) if self.r.random() < 0.03 else p

    def identifier(self) -> str:
        if self.r.random() < 0.2:
            return f"~{self.given()}_{self.sound(2, 3).capitalize()}{self.r.randint(1, 4)}"
        form = self.pick("0000-000#-####-####|0000-0000-####-####|0000-0000-####-###X|###-##-####|### ## ####|########@|@########|@#######|@@#######|@@######|@@@-#####|@@@-####|@@@-######|@@-#####|######-#######|#############|@@ ## ## ## @".split("|"))
        return self.digits(form)

    def address(self, script: str) -> str:
        r = self.r
        n = lambda m=499: str(r.randint(1, m))
        w = lambda: (self.sound(1, 2) + self.pick(["", "ton", "field", "mere", "stow", "wick", "ley", "dale"])).capitalize()
        h = lambda k=2: "".join(self.pick(HANGUL) for _ in range(k))
        c = lambda: self.pick(HAN) + self.pick(HAN)
        if script == "ko" and r.random() < 0.85:
            head = self.pick([f"{h()}시 {h()}구", f"{h()}도 {h()}시", f"{h()}특별시 {h()}구", f"{h()}광역시 {h()}구", f"{h()}도 {h()}군 {h()}읍"])
            return f"{head} {h(self.pick([2, 3]))}{self.pick(['로', '길', '대로', '동'])} {n()}" + self.pick([f"길 {n(60)}", f", {n(30)}동 {n(900)}호", f", {n(20)}층", "", f"번길 {n(60)}", f"-{n(40)}"])
        if script == "zh" and r.random() < 0.85:
            return self.pick([f"{c()}市{c()}区{c()}路{n()}号", f"{c()}市{c()}街{n()}弄{n(40)}号{n(900)}室", f"{c()}省{c()}市{c()}大道{n()}号", f"{c()}市{c()}区{c()}路{n()}号{n(30)}楼"])
        if script == "ja" and r.random() < 0.85:
            k = lambda: self.pick("霧原 鏡 月影 潮見 白鳥 桜丘 緑 青葉 中央 南 芝 港 本町 泉 若葉".split())
            return self.pick([f"{k()}市{k()}町{n(9)}-{n(30)}-{n(30)}", f"{k()}県{k()}市{k()}坂{n()}番地", f"東京都{k()}区{k()}{n(9)}-{n(30)}-{n(30)}", f"{k()}市{k()}区{k()}{n(9)}丁目{n(30)}番{n(30)}号"])
        if script == "ru" and r.random() < 0.85:
            return f"г. {self.pick(SLAVIC_ROOT)}ск, ул. {self.pick(SLAVIC_ROOT)}ская, д. {n(90)}" + self.pick(["", f", кв. {n(200)}"])
        code = f"{self.pick('ABEKNOSW')}{self.pick('ABELNOSTW')}{r.randint(0, 9)} {r.randint(0, 9)}{self.pick('ABDEZ')}{self.pick('ABDEZ')}"
        five, state = f"{r.randint(0, 99999):05d}", self.pick("CA NY TX WA MA IL OR CO".split())
        s = self.pick(STREETS)
        return self.pick([
            f"{n()}{self.pick(['', '', 'A', 'B'])} {w()} {s}, {w()} {code}", f"{n()} {w()} {w()} {s}, {w()} {code}", f"{n()} {w()} {s}, {w()}, {state} {five}", f"{n()} {w()} {s}, {w()}", f"{n()} {w()} {w()} {s}, Apt. {n(60)}, {w()}",
            f"Flat {n(30)}, {w()} House, {n()} {w()} {s}", f"Flat {n(30)}, {n()} {w()} {s}, {w()}", f"Unit {n(30)}, {n()} {w()} {s}, {w()}", f"P.O. Box {n(999)}, {w()} {self.pick(TOWNS)}", f"P.O. Box {n(999)}, {w()}", f"{w()}{self.pick(['gasse', 'straße', 'weg', 'allee', 'platz', ' Straße'])} {n()}, {five} {w()}",
            f"{n()} rue {self.pick(['de', 'du', 'des', 'de la'])} {w()}, {five} {w()}", f"{n()} rue des {w()}-{w()}, {five} {w()}", f"{n()}, avenue {w()}, {five} {w()}", f"C/ {w()} {n()}, {r.randint(1, 9)}.º {self.pick('ABCD')}, {w()}", f"C/ {w()} {w()} {n()}, {r.randint(1, 9)}.º {self.pick('ABCD')}, {w()}", f"Calle {w()} {n()}, {five} {w()}", f"Via {w()} {n()}, {five} {w()}", f"Rua {w()} {n()}, {w()}",
        ])

    def plain(self, slot: str) -> str:
        r = self.r
        if slot == "w":
            return self.pick(self.words)
        if slot == "W":
            return self.pick(self.words).capitalize() if r.random() < 0.85 else self.pick(self.words).upper()
        if slot == "T":
            a, b = self.sound(2, 3).capitalize(), self.sound(1, 2).capitalize()
            return self.pick([a + b, a + self.pick("Net GNN LM Former Bench DB Set Mix Diff Op Atlas Corpus Gen Flow BERT QA 2".split()), f"{a}-{self.pick(['GNN', '2', '50k', 'XL', 'v2', 'LM'])}", a.upper()[:4], f"{a}{r.randint(2, 99)}", a])
        if slot == "L":
            return self.family() if r.random() < 0.5 else (self.sound() + self.pick(_FAMILY_ENDS)).capitalize()
        if slot == "C":
            return (self.sound(1, 3) + self.pick(["", "ton", "ia", "a"])).capitalize()
        if slot == "Y":
            return str(r.randint(1950, 2099))
        if slot == "D":
            return self.pick([f"{r.random():.3f}", f"{r.uniform(0, 99):.1f}", str(r.randint(2, 99)), f"{r.randint(1, 99)},{r.randint(0, 999):03d}", f"{r.uniform(0, 1):.2f} ± 0.0{r.randint(1, 9)}", f"{r.randint(1, 9)}e-{r.randint(1, 9)}", f"{r.uniform(0, 99):.1f}%"])
        if slot == "d":
            return str(r.randint(1, 9)) if r.random() < 0.7 else str(r.randint(10, 99))
        return "".join(self.pick("0123456789abcdef") for _ in range(self.pick([7, 8, 8, 12])))

    def value(self, slot: str, script: str) -> str:
        return self.name(script) if slot == "N" else self.email() if slot == "E" else self.phone() if slot == "P" else self.identifier() if slot == "I" else self.address(script)

    def filled(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A context with its slots filled, and the spans of the personal data."""
        script, text, spans = _script(template), "", []
        self.rate = self.pick([0.0, 0.2, 0.5, 0.8])
        for i, part in enumerate(template.replace("}", "{").split("{")):
            if i % 2 and part in KINDS:
                value = self.value(part, script)
                spans.append((len(text), len(text) + len(value), KINDS[part]))
                text += value
            else:
                text += (self.hidden(script) if part == "h" else self.plain(part)) if i % 2 else self.shaken(part, script)
        if script == "en" and text and not (spans and spans[0][0] == 0):
            text = text[0].upper() + text[1:]
        return text, spans

    def labelled(self) -> tuple[str, list[tuple[int, int, str]]]:
        slot = self.pick("NNEPIA")
        label = self.pick(LABELS[slot])
        text = label + self.pick([": ", ": ", ": ", " - ", " ", "："])
        value = self.value(slot, _script(label))
        return text + value, [(len(text), len(text) + len(value), KINDS[slot])]

    def signed(self) -> tuple[str, list[tuple[int, int, str]]]:
        """The end of a letter: a closing, a name and what may follow it, each on its line."""
        text = self.pick(CLOSINGS)
        script = "ko" if "가" <= text[0] <= "힣" else "ru" if text[0] == "С" else self.pick(["en", "en", "en", "en", "zh", "ja", "ko"])
        lines = [self.name(script) if self.r.random() < 0.7 else self.given()]
        spans = [(len(text) + 1, len(text) + 1 + len(lines[0]), "name")]
        text += "\n" + lines[0]
        for _ in range(self.r.randint(0, 3)):
            slot = self.pick("EEPPA")
            label = self.pick(["", "", self.pick(LABELS[slot]) + self.pick([": ", " "])])
            value = self.value(slot, script)
            text += "\n" + label
            spans.append((len(text), len(text) + len(value), KINDS[slot]))
            text += value
        return text, spans


KINDS = {"N": "name", "E": "email", "P": "phone", "I": "id", "A": "address"}


def _script(template: str) -> str:
    for script, lo, hi in (("ko", "가", "힣"), ("ja", "ぁ", "ヿ"), ("zh", "一", "鿿"), ("ru", "А", "я"), ("ar", "ء", "ي"), ("hi", "अ", "ह")):
        if any(lo <= c <= hi for c in template):
            return script
    return "en"


def labelled_rows(rows: int = 4000, seed: int = 7, words: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rows`` labelled texts of one to five parts; the bound of the table. ``words`` fill the contexts of random words."""
    r = random.Random(seed)
    f = Filler(r, words or WORDS)
    table = []
    for i in range(rows):
        parts: list[tuple[str, list]] = [f.filled(r.choice(WITHOUT)) for _ in range(r.choice([0, 1, 1, 2, 3]))]
        if i % 4:
            parts.insert(r.randint(0, len(parts)), f.filled(WITH[i % len(WITH)]))
        else:
            parts.append(f.filled(WITHOUT[(i // 4) % len(WITHOUT)]))
        if r.random() < 0.15:
            at = r.randint(0, len(parts))
            parts[at:at] = [f.labelled() for _ in range(r.randint(1, 4))]
        text, spans, last = "", [], False
        for t, s in parts:
            if text:
                line = t[0] in "#*" or last or not t.rstrip()[-1] in ".!?。！？।"
                text += "\n\n" if t[0] == "#" or text.split("\n")[-1][:1] == "#" else "\n" if line else r.choice([" ", " ", " ", "\n", "\n\n", ""] if text[-1] in "。！？" else [" ", " ", " ", "\n", "\n\n"])
            spans += [(len(text) + a, len(text) + b, k) for a, b, k in s]
            text += t
            last = t.rstrip()[-1] not in ".!?。！？।"
        if r.random() < 0.22:
            t, s = f.signed()
            text += r.choice(["\n\n", "\n"])
            spans += [(len(text) + a, len(text) + b, k) for a, b, k in s]
            text += t
        table.append((text, spans))
    return table
