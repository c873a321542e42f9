"""A small labelled table for the name classifier: sentences invented for it.

``[...]`` marks a person's name; every fit puts in made-up names (``NAMES`` tells how they
are made), so that the words around a name are what is learned. All other capitals are
none: companies, places, products, languages, titles, headings.
"""

#: Parts of made-up names: beginnings, middles and endings that are joined at random.
NAMES = {
    "given": ("Al An Be Ca Da El Fa Gu Ha Iv Ja Ka Li Ma Ne Ol Pri Ro Sa Ti Va Wen Xi Yu Zo".split(), "na ri lo me tha vi do sha go ne".split(), "a o e an el y us in ia i".split()),
    "family": ("Al Bar Cas Do Es Fer Gar He Ib Ja Kow Lo Mar Na Or Pe Qui Ra Sal Tor Ur Ve Wei Yan Zu".split(), "re ni te la go va ce ri so ma".split(), "ez o a i ski er es ra z n ton ng".split()),
}

SENTENCES = """
Hola, soy [N] y trabajo en pagos.
Me llamo [N] y vivo cerca del puerto.
Mi nombre es [N].
Hablé con [N] la semana pasada.
Ayer [N] nos contó cómo empezó.
La directora, [N], abrió la jornada.
El equipo lo coordina [N] desde marzo.
Podés escribirle a [N] para más detalles.
Preguntá por [N] en la recepción.
Tu entrevista será con [N] el martes.
Con [N] armamos el área de datos.
Gracias a [N] y [N] por la ayuda.
Un saludo, [N]
Saludos cordiales, [N]
Atentamente, [N]
Firma: [N]
Responsable: [N]
Referencia personal: [N]
Contacto: [N]
Contactar a [N] antes del viernes.
Mandanos tu currículum a nombre de [N].
La búsqueda la lleva [N].
Según [N], el cambio fue rápido.
El ingeniero [N] presentó el informe.
La doctora [N] y el licenciado [N] dieron la charla.
Sr. [N], lo esperamos.
Dra. [N] atiende los lunes.
Lic. [N] firmó el acta.
Mi jefa [N] me enseñó mucho.
Mi colega [N] escribe muy bien.
Trabajé con [N] durante seis años.
Conocí a [N] en un congreso.
Felicitaciones a [N] por el premio.
[N] es la persona a cargo.
[N] se suma como gerente de producto.
[N] dirige el equipo desde enero.
[N] coordina las entrevistas.
Recomiendo a [N] sin dudar.
Postulante: [N]
Nombre: [N]
Apellido y nombre: [N]
Titular: [N]
Entrevistó [N].
Reporta a [N].
I'm [N], a writer.
I am [N] and I live by the harbour.
My name is [N].
Ask for [N] at the desk.
Contact [N] for details.
Talk to [N] before Friday.
Please contact [N].
Please call [N] first.
Please write to [N] about it.
Yesterday [N] told me about the plan.
Our founder, [N], opened the meeting.
The team is led by [N].
Your interview is with [N] on Monday.
I worked with [N] for six years.
I met [N] at a fair.
Thanks to [N] and [N] for their help.
Thank you, [N]
Best regards, [N]
Kind regards, [N]
Sincerely, [N]
Signed by [N]
Signed: [N]
Name: [N]
Applicant: [N]
Hiring manager: [N]
Reports to [N].
According to [N], the move went well.
Dr. [N] sees patients on Mondays.
Mr. [N] will call you.
Ms. [N] signed the lease.
My manager [N] taught me a lot.
My colleague [N] writes well.
Send your application to [N] by Friday.
[N] is in charge.
[N] joins as head of product.
[N] leads the office since May.
[N] said the report was late.
[N] called about the flat.
Congratulations to [N] on the prize.
Please welcome [N] to the team.
Written by [N]
Photo: [N]
Sou [N] e trabalho com vendas.
Meu nome é [N].
Falei com [N] ontem.
Fale com [N] na recepção.
Quem coordena é [N].
Contato: [N]
Obrigado a [N] e [N] pela ajuda.
Atenciosamente, [N]
Assinado: [N]
Trabalhei com [N] por seis anos.
Sua entrevista será com [N].
Segundo [N], foi rápido.
[N] lidera a equipe.
A doutora [N] atende às segundas.
La búsqueda la coordina [N].
El área la coordina [N] y crece.
Our lead, [N], joined in June.
Our editor, [N], is on leave.
[N] told me about it.
[N] told us the plan.
[N] wrote to us.
[N] me contó la idea.
[N] nos escribió ayer.
Firmado: [N]
Firmado por [N]
Meet Blue Lantern 2.0, our new product.
Meet Faro 5.1, our app.
Presentamos Faro Azul 3.0, nuestro producto.
Presentamos Granito 4.2, nuestra nueva versión.
Apresentamos Luz Verde 2.0, nosso produto.
Project Granite 4120 shipped in May.
Every Tuesday we meet.
Every Friday Morning we meet.
Each Monday we plan.
Cada Lunes Temprano planificamos.
Toda Segunda temos reunião.
Vivo en Buenos Aires desde marzo.
Nos vemos en Villa Mercedes el lunes.
La oficina queda en San Rafael, Mendoza.
La sede está en Nueva Córdoba.
Trabajo en Talleres Lumbre desde enero.
Trabajé en Grupo Andino y en Estudio Marfil.
Entré a Banco Comarca como analista.
El proyecto Aurora Boreal cerró en mayo.
El producto Faro Azul tiene mil clientes.
Usamos Google Cloud y Power BI todos los días.
Manejo Adobe Illustrator y Visual Studio.
Buscamos Analista Funcional con experiencia.
Somos Talleres Lumbre, una empresa de Rosario.
El puesto es Gerente Comercial Regional.
Licenciatura en Ciencias Económicas.
Universidad Nacional del Litoral.
Recursos Humanos te va a contactar.
Acerca Del Empleo
Quiénes Somos
Atención Al Cliente
Feliz Año Nuevo a todos.
En Semana Santa no abrimos.
El Día del Trabajador descansamos.
La Ley Micaela se dicta en abril.
La copa América Latina fue en julio.
Durante Enero Y Febrero hay guardias.
Ciencia de Datos y Marketing Digital.
Inglés Avanzado, Portugués Básico.
Nuestro cliente Acme Robotics crece.
Our client Brightwater Clinics is growing.
I live in New Haven since March.
The office is in Port Lincoln, Canada.
I work at Nordvik Software since May.
I worked for Silver Harbor Foods and Acme Robotics.
I joined Pelham Bank as an analyst.
The project Northern Light closed in May.
The product Blue Lantern has many users.
We use Google Cloud and Power BI every day.
I use Adobe Illustrator and Visual Studio.
We need a Senior Product Designer.
The role is Regional Sales Manager.
Bachelor of Computer Science.
University of South Ridge.
Human Resources will call you.
About The Role
Who We Are
Customer Success
Happy New Year to all.
We close for Easter Week.
Data Science and Digital Marketing.
Advanced English, Basic French.
Monday To Friday, nine to five.
Machine Learning and Open Source.
Moro em Porto Velho desde março.
Trabalho no Banco Serrano desde maio.
O projeto Luz Verde terminou.
Usamos Google Cloud e Power BI.
Ciência de Dados e Marketing Digital.
Recursos Humanos vai ligar.
Full Stack Developer
Scrum Master
Calle San Martín, cerca de Plaza Mayor.
Avenida Santa Fe y Callao.
Nuestra sede en Torre Norte abre temprano.
Fundación Puente Vivo organiza la feria.
Java Y Python
Estimado Equipo, gracias.
Dear Hiring Team, thanks.
Estimada Comisión Evaluadora
Gracias a Talleres Lumbre por el apoyo.
Thanks to Acme Robotics for the support.
Hablé con Recursos Humanos ayer.
Contact Human Resources for details.
Contacto: Mesa de Ayuda
Con Google Cloud armamos el área.
"""
